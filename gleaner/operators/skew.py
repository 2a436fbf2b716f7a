"""Building blocks that stay balanced when one key holds much of a table."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 20
"""Most rows of one key that a window sorts in one task."""

RANGES_PER_TASK = 4
"""Most ranges for each shuffle partition, unless rows are so many that ``CHUNK_ROWS`` asks for more."""

MAX_BROADCAST_ROWS = 100_000
"""Most rows that are broadcast, where the size is counted or given."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the cluster names it.

    Only a local session (tests, a laptop) may fall back to a folder of its
    own; on a cluster a machine-local folder would be lost with its machine.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gleaner-")
    spark.sparkContext.setCheckpointDir(named)
    return named


_scratch: list[list[DataFrame]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read back from shared storage."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``cut_lineage`` stores inside is deleted at the end.

    For a step that leaves its result elsewhere: a frame that still reads such
    a checkpoint fails afterwards.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if file.isDefined():
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when ``rows``, its known upper bound, allows it.

    Beyond the bound the join is left to Spark, which shuffles both sides.
    """
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def join_hot(left: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """``left.join(counted, key)``, where ``left`` may hold a hot key and ``counted`` was grouped by ``key``.

    Grouping leaves rows dealt out by key. A join that takes them as they lie
    can't be split by Spark (AQE), so a second key has both sides dealt out anew.
    """
    again = F.xxhash64(key)
    return left.withColumn("_again", again).join(counted.withColumn("_again", again), [key, "_again"]).drop("_again")


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "tid", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the rows of each key 0, 1, 2... by ``order``, of any types.

    Keys of up to ``chunk_rows`` rows are numbered by one window. The rows of
    larger keys are dealt to ranges of key and order, numbered within each range
    and shifted by the rows of the key in the ranges before it, so that no task
    sorts a whole hot key, whatever its values and ties.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > chunk_rows)
    known = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    w = Window.partitionBy(*keys).orderBy(*order)
    if not known[0]:
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))

    marked = at_most(hot.select(*keys), known[0])
    cold = df.join(marked, keys, "left_anti").withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    # Spark samples rows for each range on the driver. Small chunks must not make that grow with the table, and
    # ranges beyond a few for each task make no task smaller.
    enough = RANGES_PER_TASK * max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    ranges = max(2, min(2 * -(-known[1] // chunk_rows), max(enough, 2 * -(-known[1] // CHUNK_ROWS))))
    # Ties on everything are equal rows; a hash of the row number deals them out without changing the order.
    dealt = df.join(marked, keys, "left_semi").withColumn("_deal", F.monotonically_increasing_id())
    ranged = cut_lineage(dealt.repartitionByRange(ranges, *keys, *order, "_deal").withColumn("_range", F.spark_partition_id()))
    numbered = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order, "_deal")) - 1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    shifted = numbered.join(shifts, [*keys, "_range"]).withColumn(out, (F.col("_rn") + F.col("_shift")).cast("long"))
    return cold.unionByName(shifted.select(*cold.columns))
