"""Hard negatives by exact integer scores in float32.

A score is the inner product of two vectors of whole numbers. It is taken in a
residue number system: modulo several small primes the components are small
enough for float32 matrix products to be exact, and the residues of a score give
the score back, sign included, by Chinese remaindering. How many primes it takes
follows from the largest lengths of the vectors.

Anchors and rows are dealt to blocks by a hash of their id, and each pair of
blocks is one group: a task multiplies whole blocks and returns, for each of its
anchors, only the few best rows, whatever copies and labels they hold. Spark
merges the partial lists. Positives come first; their scores then set the window
in which negatives are sought.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.store import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
"""A negative's score lies between these hundredths of the positive's score."""
ANCHOR_BLOCK, ROW_BLOCK = 2048, 32_768
_ROW_SLAB, _ANCHOR_SLAB = 8192, 128
PRIMES = (997, 991, 983, 977, 971, 967, 953, 947, 941, 937, 929, 919)
"""Half of the largest, squared, times ``_DEPTH`` stays below 2 ** 24, where float32 is exact."""
_DEPTH = 67
_LONG = 1 << 62
_NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id, label, x`` of the rows of ``rows`` (``vec_id, embedding, label``) that take part.

    Rows go whose id, label or vector is null or whose vector holds null or
    non-finite entries. ``x`` holds ``floor(SCALE * c)`` as doubles, which are
    whole and exact. Of rows that share an id one stays, by label, then vector.
    """
    c = F.col("embedding")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c.cast("array<double>"), lambda v: _floor(v * SCALE))
    kept = rows.where(c.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(finite)
    kept = kept.select("vec_id", F.struct((F.col("label") if label is None else label).alias("label"), x.alias("x")).alias("s"))
    return kept.groupBy("vec_id").agg(F.min("s").alias("s")).select("vec_id", "s.label", "s.x")


def _floor(v: Column) -> Column:
    """Floor of a double as a double of any size; beyond 2 ** 52 all are whole."""
    return F.when(F.abs(v) < 2.0 ** 52, F.floor(F.when(F.abs(v) < 2.0 ** 52, v)).cast("double")).otherwise(v)


def mined(points: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows of ``points`` (``vec_id, label, x``, ids unique) for
    which ``is_anchor`` holds. An anchor's positives are its first other rows of
    the same label; of a positive's negatives, rows of other labels with a score
    between ``LOW`` and ``HIGH`` hundredths of the positive's, the first are
    returned. Higher scores come first, then smaller ids. A vector shorter than
    another counts as filled up with zeros. Scores must fit a long; others raise.
    """
    spark = points.sparkSession
    points = stored(points)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    anchors = points.where(is_anchor).select(*[F.col(c).alias(c) for c in points.columns])  # columns of their own, for the cogroup
    sizes = points.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("x"))).first()
    of_anchors = anchors.agg(F.count(F.lit(1)), F.max(square)).first()
    schema = "anchor_id long, positive_id long, positive_score long"
    if not of_anchors[0]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    primes = moduli((sizes[1] * of_anchors[1]) ** 0.5)
    row_blocks = max(-(-sizes[0] // ROW_BLOCK), min(spark.sparkContext.defaultParallelism, -(-sizes[0] // _ROW_SLAB)))
    anchor_blocks = -(-of_anchors[0] // ANCHOR_BLOCK)
    wide = sizes[2]

    def dealt(df: DataFrame, blocks: int, own: str, other_blocks: int, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other)
        return df.select("*", F.pmod(F.xxhash64(F.col("vec_id"), F.lit(own)), F.lit(blocks)).cast("int").alias(own), every)

    key = ["_gl_a", "_gl_r"]
    rows = dealt(points, row_blocks, "_gl_r", anchor_blocks, "_gl_a").groupBy(*key)
    near = dealt(anchors, anchor_blocks, "_gl_a", row_blocks, "_gl_r").groupBy(*key).cogroup(rows).applyInArrow(_positives(primes, wide, positives), schema)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("_gl_n", F.row_number().over(order)).where(F.col("_gl_n") <= positives).drop("_gl_n")
    near = stored(near)
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p"))
    sought = anchors.join(lists, anchors["vec_id"] == lists["anchor_id"]).select("vec_id", "label", "x", F.col("p.positive_id").alias("pid"), F.col("p.positive_score").alias("ps"))
    found = dealt(sought, anchor_blocks, "_gl_a", row_blocks, "_gl_r").groupBy(*key).cogroup(rows).applyInArrow(
        _negatives(primes, wide, negatives), schema + ", negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# --- residue numbers ----------------------------------------------------------------


def moduli(largest: float) -> tuple[int, ...]:
    """As many primes as tell all whole numbers from ``-largest`` to ``largest`` apart."""
    if not largest < 2.0 ** 61:
        raise ValueError(f"scores of up to {largest:g} don't fit a long")
    room, taken = 2 * int(largest * (1 + 1e-9)) + 3, 1
    product = PRIMES[0]
    while product < room:
        product *= PRIMES[taken]
        taken += 1
    return PRIMES[:taken]


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole doubles of any size modulo ``p``, between ``-p / 2`` and ``p / 2``."""
    r = np.fmod(x, p)
    r -= p * np.rint(r / p)
    return r.astype(np.float32)


def multiplied(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` of residues, from 0 to ``p - 1``; sums of ``_DEPTH`` products at a time are exact."""
    total = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], _DEPTH):
        part = a[:, at: at + _DEPTH] @ b[:, at: at + _DEPTH].T
        part -= p * np.rint(part * np.float32(1 / p))  # small again, so the sum stays exact
        total += part
        total -= p * np.rint(total * np.float32(1 / p))
    out = total.astype(np.int64)
    out %= p
    return out


def recovered(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The numbers that have these residues, nearest to 0, digit by digit of the mixed radix."""
    # A prime more than needed could pass 2 ** 63; wrapping keeps the last 64 bits right, and the number itself fits them.
    total, product = parts[0].copy(), primes[0]
    digits = [(parts[0], 1)]
    for part, p in zip(parts[1:], primes[1:], strict=True):
        known = np.zeros_like(part)
        for digit, weight in digits:
            known += digit * (weight % p) % p
        digit = (part - known) * pow(product, -1, p) % p
        digits.append((digit, product))
        total += digit * np.int64(_wrapped(product))
        product *= p
    # Halves are told apart by the digits from the top; the top half stands for negative numbers.
    above, equal = np.zeros(total.shape, bool), np.ones(total.shape, bool)
    half = product // 2
    for digit, weight in reversed(digits):
        own = half // weight
        half -= own * weight
        above |= equal & (digit > own)
        equal &= digit == own
    total[above] += np.int64(_wrapped(-product))
    return total


def _wrapped(v: int) -> int:
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >= 1 << 63 else v


def scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of rows of whole doubles."""
    with np.errstate(over="ignore"):
        return recovered([multiplied(residues(a, p), residues(b, p), p) for p in primes], primes)


# --- inside tasks -------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    column = column.combine_chunks()
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == wide).all():
        return flat.reshape(-1, wide)
    out = np.zeros((len(lengths), wide))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _slabs(left: pa.Table, right: pa.Table, primes: tuple[int, ...], wide: int):
    """``(anchor places, row places, scores)`` a slab of both at a time; rows in the order of their ids."""
    right = right.sort_by("vec_id")
    a, b = _matrix(left.column("x"), wide), _matrix(right.column("x"), wide)
    ready = [residues(a, p) for p in primes]
    for at in range(0, len(b), _ROW_SLAB):
        own = [residues(b[at: at + _ROW_SLAB], p) for p in primes]
        for first in range(0, len(a), _ANCHOR_SLAB):
            with np.errstate(over="ignore"):
                found = recovered([multiplied(r[first: first + _ANCHOR_SLAB], o, p) for r, o, p in zip(ready, own, primes, strict=True)], primes)
            yield slice(first, first + _ANCHOR_SLAB), slice(at, at + _ROW_SLAB), found, right


def _first(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of up to ``k`` largest of each row, the first of equals, in any order, and which of the places count."""
    k = min(k, found.shape[1])
    cut = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k, None]
    above, equal = found > cut, found == cut
    taken = (above | equal & (equal.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True))) & (found > _NONE)
    rows, cols = np.nonzero(taken)
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    at, counts = np.zeros((len(found), k), np.int64), np.zeros((len(found), k), bool)
    at[rows, rank], counts[rows, rank] = cols, True
    return at, counts


class _Best:
    """The best ``k`` of each list so far, as ``(list, score, id)``."""

    def __init__(self, lists: int, k: int):
        self.k, self.scores = k, np.full((lists, k), _NONE, np.int64)
        self.ids = np.full((lists, k), np.iinfo(np.int64).max, np.int64)

    def add(self, lists: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        at, counts = _first(found, self.k)
        own = np.where(counts, np.take_along_axis(found, at, axis=1), _NONE)
        both = np.concatenate([self.scores[lists], own], axis=1)
        names = np.concatenate([self.ids[lists], np.where(counts, ids[at], np.iinfo(np.int64).max)], axis=1)
        order = np.lexsort((names, ~both), axis=1)[:, : self.k]
        self.scores[lists], self.ids[lists] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, at = np.nonzero(self.scores > _NONE)
        return lists, self.ids[lists, at], self.scores[lists, at]


def _positives(primes: tuple[int, ...], wide: int, k: int):
    def run(left, right):
        ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        best = _Best(len(ids), k)
        for i, j, found, rows in _slabs(left, right, primes, wide):
            others = rows.column("vec_id").to_numpy()[j]
            fit = (labels[i, None] == rows.column("label").to_numpy()[None, j]) & (ids[i, None] != others[None])
            best.add(np.arange(len(ids))[i], np.where(fit, found, _NONE), others)
        lists, names, values = best.rows()
        return pa.table({"anchor_id": pa.array(ids[lists], pa.int64()), "positive_id": names, "positive_score": values})
    return run


def _negatives(primes: tuple[int, ...], wide: int, k: int):
    def run(left, right):
        ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        many = left.column("pid").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int64)
        starts = np.cumsum(many) - many
        positives, theirs = (left.column(c).combine_chunks().flatten().to_numpy() for c in ("pid", "ps"))
        # 100 * score from LOW * p to HIGH * p, without leaving a long.
        least = [-(-LOW * int(p) // 100) for p in theirs]
        most = [HIGH * int(p) // 100 for p in theirs]
        least, most = np.array(least, np.int64), np.array(most, np.int64)
        best = _Best(len(positives), k)
        for i, j, found, rows in _slabs(left, right, primes, wide):
            others = rows.column("vec_id").to_numpy()[j]
            unlike = np.where(labels[i, None] != rows.column("label").to_numpy()[None, j], found, _NONE)
            for turn in range(int(many[i].max(initial=0))):
                own = np.flatnonzero(many[i] > turn)
                lists = starts[i][own] + turn
                part = unlike[own]
                best.add(lists, np.where((part >= least[lists, None]) & (part <= most[lists, None]), part, _NONE), others)
        lists, names, values = best.rows()
        owner = np.repeat(ids, many)
        return pa.table({"anchor_id": pa.array(owner[lists], pa.int64()), "positive_id": pa.array(positives[lists], pa.int64()), "positive_score": pa.array(theirs[lists], pa.int64()),
                         "negative_id": names, "negative_score": values})
    return run
