"""Exact "first k rows by an order", for small and for very large k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.skew import cut_lineage

DIRECT_ROWS = 2_000_000
"""Most rows that Spark's own sort and limit may gather in one task, counted over all partitions."""


@dataclass(frozen=True)
class By:
    """One sort column. NULL and NaN come last in either direction."""

    column: str
    descending: bool = False

    def order(self, kind: str) -> Column:
        value = F.col(self.column)
        if kind in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        return value.desc_nulls_last() if self.descending else value.asc_nulls_last()


def _partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def direct_most(spark: SparkSession, direct_rows: int = DIRECT_ROWS) -> int:
    """Most rows that ``first_k`` finds by sort and limit."""
    return direct_rows // _partitions(spark)


def first_k(df: DataFrame, order: list[By], k: int, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """The ``k`` first rows by ``order``, fewer when the table is smaller.

    Sort and limit keeps k rows of each partition and gathers them in one task.
    Where that could be more than ``direct_rows``, the rows are dealt to ranges
    of the order and counted; the ranges before the cut are in, and the search
    goes on within the range that the cut falls into. Both ways give the same
    rows for any types, NULLs and ties; rows that are equal in all sort columns
    are interchangeable.
    """
    if k <= 0:
        return df.limit(0)
    partitions = _partitions(df.sparkSession)
    kinds = dict(df.dtypes)
    keys = [b.order(kinds[b.column]) for b in order]
    if k * partitions <= direct_rows:
        return df.orderBy(*keys).limit(k)
    ranged = cut_lineage(df.repartitionByRange(partitions, *keys).withColumn("_range", F.spark_partition_id()))
    sizes = sorted(map(tuple, ranged.groupBy("_range").count().collect()))  # a row for each partition
    done = 0
    for at, n in sizes:
        if done + n > k:
            break
        done += n
    else:
        return ranged.drop("_range")
    inside, cut = ranged.where(F.col("_range") < at).drop("_range"), ranged.where(F.col("_range") == at).drop("_range")
    if done == k:
        return inside
    if done == 0 and len(sizes) == 1:  # no range can be split: equal rows, or too few of them to matter
        return cut.orderBy(*keys).limit(k)
    return inside.unionByName(first_k(cut, order, k - done, direct_rows))
