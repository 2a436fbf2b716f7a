"""What a run has reached, in shared storage.

A step of a run is over once its manifest stands there; a manifest appears in
one step and names the data it speaks for. Labels are kept as one part for each
round, with what that round added, so a label is stored once however many rounds
follow. A run that breaks goes on behind its last whole step; parts without a
manifest are what a broken step left and are deleted then.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources import files

LABELLED = "sid long, tid long, tag string"
BEGUN, REACHED, LABELLED_STEP, SCORED = "begun", "reached", "labelled", "scored"


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.steps: dict[tuple[str, int], dict] = {}
        for name in files.names(spark, f"{self.path}/steps"):
            step = json.loads(files.text_of(spark, f"{self.path}/steps/{name}"))
            self.steps[step["step"], step["round"]] = step

    def step(self, kind: str, round_no: int = 0) -> dict | None:
        return self.steps.get((kind, round_no))

    def commit(self, kind: str, round_no: int = 0, **facts) -> None:
        step = {"step": kind, "round": round_no, **facts}
        if not files.put(self.spark, f"{self.path}/steps/{round_no:06d}-{kind}.json", json.dumps(step)):
            raise RuntimeError(f"another process runs {self.path}: {kind} of round {round_no} is there already")
        self.steps[kind, round_no] = step

    def keep(self, kind: str, df: DataFrame, round_no: int = 0, **facts) -> None:
        """Write ``df`` and commit the step that it is the data of."""
        part = f"{kind}/round={round_no}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        self.commit(kind, round_no, part=part, schema=df.schema.json(), **facts)

    def data(self, kind: str, round_no: int = 0) -> DataFrame:
        from pyspark.sql.types import StructType

        step = self.steps[kind, round_no]
        return self.spark.read.schema(StructType.fromJson(json.loads(step["schema"]))).parquet(f"{self.path}/{step['part']}")

    def all_data(self, kind: str, up_to: int) -> DataFrame:
        """The data of all rounds up to one, which have the same columns: one scan."""
        from pyspark.sql.types import StructType

        steps = [self.steps[kind, n] for n in range(up_to + 1)]
        return self.spark.read.schema(StructType.fromJson(json.loads(steps[0]["schema"]))).parquet(*[f"{self.path}/{s['part']}" for s in steps])

    def added(self, round_no: int) -> DataFrame:
        """``sid, tid, tag`` of what a round added, without a hint as to its size."""
        return self.spark.read.schema(LABELLED).parquet(f"{self.path}/{self.steps[LABELLED_STEP, round_no]['part']}")

    def labelled(self, up_to: int | None = None) -> DataFrame:
        """``sid, tid, tag, round`` of all that was added up to a round: one scan of as many folders as rounds.

        Labels compress to a few bytes each, so the size of their files says
        nothing of the memory that they take; they are joined by sorting, never
        broadcast for their small files.
        """
        parts = [s["part"] for (kind, n), s in sorted(self.steps.items()) if kind == LABELLED_STEP and (up_to is None or n <= up_to)]
        if not parts:
            return self.spark.createDataFrame([], LABELLED + ", round int")
        rows = self.spark.read.schema(LABELLED + ", round int").option("basePath", f"{self.path}/{LABELLED_STEP}")
        return rows.parquet(*[f"{self.path}/{p}" for p in parts]).select("sid", "tid", "tag", F.col("round").cast("int").alias("round")).hint("merge")

    def tidy(self) -> None:
        """Delete what no manifest speaks for."""
        kept = {s["part"] for s in self.steps.values() if "part" in s}
        for kind in (BEGUN, REACHED, LABELLED_STEP):
            for folder in files.names(self.spark, f"{self.path}/{kind}"):
                for name in files.names(self.spark, f"{self.path}/{kind}/{folder}"):
                    if f"{kind}/{folder}/{name}" not in kept:
                        files.delete(self.spark, f"{self.path}/{kind}/{folder}/{name}")
