"""A log of run records in which each record stands exactly once.

A record goes by its ``run`` and ``round``. Records are written to a part of
their own, and a marker for each then says which part holds it. A marker is
created in one step and never replaced, so of appends that are repeated, retried
or run side by side the first one counts, and what a broken append left behind
is not read.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.skew import at_most
from gleaner.sources import files

KEYS = "run string, round int, part string"


def append(results: DataFrame, path: str, fmt: str = "json") -> int:
    """Add the records of ``results`` that the log doesn't hold; returns how many.

    ``results`` needs ``run`` and ``round``, one row for each; a run is a
    series of rounds, so its keys are few. JSON gives one record per line.
    """
    spark = results.sparkSession
    known = {(r["run"], r["round"]) for r in committed(spark, path).select("run", "round").collect()}
    keys = [(r["run"], r["round"]) for r in results.select("run", "round").collect()]
    if len(set(keys)) != len(keys) or any(run is None or n is None for run, n in keys):
        raise ValueError("records need a run and a round, and no two the same")
    fresh = [k for k in keys if k not in known]
    if not fresh:
        return 0
    part = uuid.uuid4().hex
    wanted = spark.createDataFrame(fresh, "run string, round int")
    results.join(at_most(wanted, len(fresh)), ["run", "round"], "left_semi").write.format(fmt).save(f"{path}/data/part={part}")
    return sum(
        files.put(spark, f"{path}/commits/{quote(run, safe='')}-{n:06d}.json", json.dumps({"run": run, "round": n, "part": part}))
        for run, n in fresh)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``run, round, part`` of each record."""
    if not files.names(spark, f"{path}/commits"):
        return spark.createDataFrame([], KEYS)
    return spark.read.schema(KEYS).json(f"{path}/commits")


def read(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """The records, with the columns of ``schema``; an empty log has none."""
    keys = committed(spark, path)
    n = keys.count()
    if not n:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", part string").format(fmt).load(f"{path}/data")
    return rows.join(at_most(keys, n), ["run", "round", "part"], "left_semi").drop("part")
