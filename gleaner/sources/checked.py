"""Reading corpora that may hold bad records.

Every record comes out once: as an accepted row, or as a reject with the reasons
and the record itself. Checks look at one row at a time, so they cost no shuffle
and both tables come from one scan each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.corpus import FLAT_SCHEMA, NESTED_SCHEMA

CORRUPT = "_corrupt_record"
SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class Checked:
    accepted: DataFrame
    """Rows of the corpus' own columns."""

    rejects: DataFrame
    """``(id, split, reasons ARRAY<STRING>, record STRING)``; ``id`` is null where it couldn't be read."""


def read_flat(spark: SparkSession, path: str, fmt: str, n_tags: int, n_pos: int | None = None, n_fine: int | None = None) -> Checked:
    """Flat sentences; ``pos_tags`` and ``fine_ner_tags`` are asked for where the size of their vocabulary is given."""
    rows = _read(spark, FLAT_SCHEMA, path, fmt)
    needed = {"ner_tags": n_tags, "pos_tags": n_pos, "fine_ner_tags": n_fine}
    lists = {c: (F.col(c), n) for c, n in needed.items() if n is not None}
    return _parted(rows, "id", _problems(F.col("tokens"), lists))


def read_nested(spark: SparkSession, path: str, fmt: str, n_tags: int, n_pos: int) -> Checked:
    """Nested documents; one bad sentence rejects its document, with the reasons of all of its sentences."""
    rows = _read(spark, NESTED_SCHEMA, path, fmt)

    def of_sentence(s: Column) -> Column:
        problems = _problems(s["words"], {"ner_tags": (s["named_entities"], n_tags), "pos_tags": (s["pos_tags"], n_pos)})
        return F.when(s.isNull(), F.array(F.lit("sentences"))).otherwise(F.array_compact(F.array(*[F.when(bad, name) for name, bad in problems.items()])))

    names = list(_problems(F.lit(None), {"ner_tags": (F.lit(None), n_tags), "pos_tags": (F.lit(None), n_pos)}))
    found = F.flatten(F.transform("sentences", of_sentence))
    problems = {"sentences": F.col("sentences").isNull() | F.array_contains(found, "sentences")}
    problems |= {name: F.coalesce(F.array_contains(found, name), F.lit(False)) for name in names}
    return _parted(rows, "document_id", problems)


def _read(spark: SparkSession, schema: str, path: str, fmt: str) -> DataFrame:
    if fmt == "json":  # lines that are no record are kept as they are
        return spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).format(fmt).load(path).withColumn(CORRUPT, F.lit(None).cast("string"))


def _problems(tokens: Column, lists: dict[str, tuple[Column, int]]) -> dict[str, Column]:
    """By name, whether a sentence has the fault; never null."""
    found = {"tokens": tokens.isNull() | F.coalesce(F.exists(tokens.cast("array<string>"), lambda t: t.isNull()), F.lit(False))}
    found |= {name: c.isNull() for name, (c, _) in lists.items()}
    for name, (c, n) in lists.items():
        c = c.cast("array<int>")
        found[f"{name} length"] = c.isNotNull() & tokens.isNotNull() & (F.size(c) != F.size(tokens.cast("array<string>")))
        found[f"{name} range"] = F.coalesce(F.exists(c, _outside(n)), F.lit(False))
    return found


def _outside(n: int):
    return lambda t: t.isNull() | (t < 0) | (t >= n)


def _parted(rows: DataFrame, key: str, problems: dict[str, Column]) -> Checked:
    problems = {"id": F.col(key).isNull(), "split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), **problems}
    reasons = F.array_compact(F.array(*[F.when(bad, name) for name, bad in problems.items()]))
    reasons = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("corrupt"))).otherwise(reasons)
    columns = [c for c in rows.columns if c != CORRUPT]
    judged = rows.withColumn("_reasons", reasons)
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*columns)))
    return Checked(
        judged.where(F.size("_reasons") == 0).select(*columns),
        judged.where(F.size("_reasons") > 0).select(F.col(key).alias("id"), "split", F.col("_reasons").alias("reasons"), record.alias("record")))
