"""Looking up what is known of a key, for many rows of few or of very many keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import MAX_BROADCAST_ROWS, cut_lineage
from gleaner.operators.topk import By, first_k


def join_counted(left: DataFrame, counted: DataFrame, n: int, key: str, often: str, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``left.join(counted, key, "left")``, where ``counted`` has ``n`` rows, one for each key.

    Up to ``most`` keys are broadcast. Of more, those with the greatest ``often``
    are, and only rows of ``left`` that none of them matches are shuffled, to the
    other keys. ``counted`` is read several times, so it should be stored.
    """
    if n <= most:
        return left.join(F.broadcast(counted), key, "left")
    top = cut_lineage(first_k(counted, [By(often, True), By(key)], most))
    marked = F.broadcast(top.select(key))
    rare = counted.join(marked, key, "left_anti").withColumnRenamed(key, "_key")
    # Stored rows may lie dealt out by key; with a second one both sides are dealt anew, so that Spark can split a hot key (AQE).
    same = (F.col(key) == F.col("_key")) & (F.xxhash64(key) == F.xxhash64("_key"))
    others = left.join(marked, key, "left_anti").join(rare, same, "left")
    near = left.join(F.broadcast(top), key)
    return near.unionByName(others.select(near.columns))
