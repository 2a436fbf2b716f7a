"""TF-IDF weights as a long table ``(sid, term, w)``.

Texts are dealt to blocks of some megabytes, and a block's texts are shuffled,
not their terms. A block sends each of its distinct terms once, with the number
of its texts that hold it, and gets back in how many texts it is in all; it then
weighs its texts, whole rows, by itself.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import english_stop_words, terms
from gleaner.operators.skew import join_hot

# The functions that run inside tasks are shipped whole, so that executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CHARS = 8_000_000
"""Characters of text in a block, unless one text has more."""

@dataclass(frozen=True)
class Vectorizer:
    """How text becomes weighted terms.

    ``stop_words`` is a list, ``"english"`` for the list of Spark ML, or None.
    ``norm`` is None or ``"l2"``.
    """

    ngrams: tuple[int, int] = (1, 2)
    stop_words: list[str] | str | None = None
    norm: str | None = None

    def words(self) -> list[str] | None:
        return english_stop_words() if self.stop_words == "english" else self.stop_words

    def terms(self, text: Column) -> Column:
        return terms(text, self.ngrams, self.words())


def term_counts(texts: DataFrame, how: Vectorizer, ids: bool = False) -> DataFrame:
    """``texts(sid, text)`` to ``(sid, term, tf)``, or with ``ids`` to ``(sid, id, tf)``, terms as 64-bit hashes.

    A text is one row, so its repeats combine before the shuffle, and not a
    string of it is shuffled where hashes do.
    """
    found = how.terms(F.col("text"))
    name = "id" if ids else "term"
    listed = texts.select("sid", F.explode(F.transform(found, lambda t: F.xxhash64(t)) if ids else found).alias(name))
    return listed.groupBy("sid", name).agg(F.count(F.lit(1)).alias("tf"))


def weighted(counts: DataFrame, n: int) -> DataFrame:
    """``w`` beside ``tf`` and ``df``: ``tf * (ln((1 + n) / (1 + df)) + 1)``."""
    return counts.withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1))


def tfidf(texts: DataFrame, how: Vectorizer = Vectorizer(), with_df: bool = False, ids: bool = False) -> DataFrame:
    """``tf * (ln((1 + n) / (1 + df)) + 1)``, optionally scaled to length 1 per row.

    ``with_df`` keeps the number of texts each term is in, as ``df``. With
    ``ids`` terms are numbers, for those who don't read them.
    """
    name = "id" if ids else "term"
    if how.norm not in (None, "l2"):
        raise ValueError(f"unknown norm {how.norm!r}")
    n, chars, single = _sizes(texts)
    if not single:
        return _joined(texts, how, n, with_df, ids)

    def rows(sids: pa.Array, of: np.ndarray, found: pa.Array, df: np.ndarray, w: np.ndarray) -> dict:
        return {"sid": sids.take(pa.array(of)), name: found, "w": w} | ({"df": df} if with_df else {})
    kind = texts.schema["sid"].dataType.simpleString()
    schema = f"sid {kind}, {name} {'long' if ids else 'string'}, w double" + (", df long" if with_df else "")
    return _in_blocks(texts, how, n, chars, ids, rows, schema)


def tfidf_rows(texts: DataFrame, how: Vectorizer = Vectorizer()) -> DataFrame:
    """The same weights, one row per text with terms: ``(sid, ids ARRAY<LONG>, ws ARRAY<DOUBLE>)``, ids ascending.

    Terms are numbers. A block writes its texts whole, so their terms are neither spread out nor gathered again.
    """
    if how.norm not in (None, "l2"):
        raise ValueError(f"unknown norm {how.norm!r}")
    n, chars, single = _sizes(texts)
    if not single:
        entry = F.array_sort(F.collect_list(F.struct("id", "w"))).alias("e")
        packed = _joined(texts, how, n, False, True).groupBy("sid").agg(entry)
        return packed.select("sid", F.col("e.id").alias("ids"), F.col("e.w").alias("ws"))

    def rows(sids: pa.Array, of: np.ndarray, found: pa.Array, df: np.ndarray, w: np.ndarray) -> dict:
        ids = found.to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, of))
        texts_of, starts = np.unique(of, return_index=True)
        ends = np.r_[starts, len(of)]
        return {"sid": sids.take(pa.array(texts_of)), "ids": _lists(pa.array(ids[order]), ends), "ws": _lists(pa.array(w[order]), ends)}
    kind = texts.schema["sid"].dataType.simpleString()
    return _in_blocks(texts, how, n, chars, True, rows, f"sid {kind}, ids array<bigint>, ws array<double>")


def _sizes(texts: DataFrame) -> tuple[int, int, bool]:
    """Texts, their characters, and whether each has an id of its own."""
    found = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count_distinct("sid")).first()
    return found[0], found[1], found[0] == found[2]


def _joined(texts: DataFrame, how: Vectorizer, n: int, with_df: bool, ids: bool) -> DataFrame:
    """The same for texts of several rows: terms are counted and joined one by one."""
    counts, name = term_counts(texts, how, ids), "id" if ids else "term"
    # Reading tf here keeps this plan over `counts` equal to the one below, so
    # that Spark splits and shuffles the texts once for both.
    dfs = counts.groupBy(name).agg(F.count_if(F.col("tf") > 0).alias("df"))
    # The rows of a frequent term are split by Spark when they are joined (AQE, skewed sort-merge joins).
    rows = weighted(join_hot(counts, dfs, name), n).select("sid", name, "w", *(["df"] if with_df else []))
    if how.norm is None:
        return rows
    # A row of text bounds its number of terms, so this window is bounded too.
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("sid")))
    return rows.withColumn("w", F.col("w") / length)


def _distinct(found: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct terms by ``part`` and term: ``part``, term; then for each term of a text its text, the term's place, its count."""
    column, parts = (found.column(c).combine_chunks() for c in ("terms", "parts"))
    column, parts = (c if isinstance(c, pa.Array) else c.chunk(0) for c in (column, parts))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = column.flatten().dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    part_of = np.zeros(len(coded.dictionary), np.int64)
    part_of[place] = parts.flatten().to_numpy(zero_copy_only=False)
    by_term = pc.array_sort_indices(coded.dictionary).to_numpy()
    order = by_term[np.argsort(part_of[by_term], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cells = np.repeat(np.arange(len(lengths)), lengths) * max(1, len(order)) + rank[place]
    cells, tf = np.unique(cells, return_counts=True)
    return part_of[order], coded.dictionary.take(pa.array(order)), cells // max(1, len(order)), cells % max(1, len(order)), tf


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _in_blocks(texts: DataFrame, how: Vectorizer, n: int, chars: int, ids: bool, finish: Callable[..., dict], schema: str) -> DataFrame:
    """``finish`` of each block: its ids, then text number, term, df and weight of each of its cells, texts in turn."""
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = max(min(4 * tasks, -(-chars // (BLOCK_CHARS // 8))), -(-chars // BLOCK_CHARS), 1)
    parts = max(1, blocks // 2)
    norm = how.norm
    dealt = texts.select("sid", "text", F.pmod(F.xxhash64("sid"), F.lit(blocks)).alias("block")).repartition(tasks, "block").sortWithinPartitions("block")
    found = how.terms(F.col("text"))
    listed = dealt.select("block", "sid", (F.transform(found, lambda t: F.xxhash64(t)) if ids else found).alias("terms"))
    part = (lambda t: F.pmod(t, F.lit(parts))) if ids else (lambda t: F.pmod(F.xxhash64(t), F.lit(parts)))
    listed = listed.withColumn("parts", F.transform("terms", lambda t: part(t).cast("int")))

    def vocabulary(block: pa.Table) -> pa.Table:
        part_of, found, _, place, _ = _distinct(block)
        own, starts = np.unique(part_of, return_index=True)
        ends = np.r_[starts, len(part_of)]
        here = np.bincount(place, minlength=len(part_of))
        return pa.table({"block": pa.array(np.full(len(own), block.column("block")[0].as_py())), "part": pa.array(own),
                         "found": _lists(found, ends), "texts": _lists(pa.array(here.astype(np.int64)), ends)})

    def total(part: pa.Table) -> pa.Table:
        column, here = (pa.concat_arrays(part.column(c).chunks) for c in ("found", "texts"))
        place = column.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        df = np.zeros(place.max() + 1, np.int64)
        np.add.at(df, place, here.flatten().to_numpy(zero_copy_only=False))
        ends = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]
        return pa.table({"block": part.column("block"), "part": part.column("part"), "df": _lists(pa.array(df[place]), ends)})

    def weigh(block: pa.Table, totals: pa.Table) -> pa.Table:
        if not len(totals):  # no text of the block has a term
            return empty
        _, found, of, place, tf = _distinct(block)
        df = pa.concat_arrays(totals.sort_by("part").column("df").chunks).flatten().to_numpy(zero_copy_only=False)[place]
        w = tf * (np.log((1.0 + n) / (df + 1)) + 1)
        if norm:
            w = w / np.sqrt(np.bincount(of, weights=w * w))[of]
        return pa.table(finish(block.column("sid").combine_chunks(), of, found.take(pa.array(place)), df, w))

    kind = "bigint" if ids else "string"
    words = listed.groupBy("block").applyInArrow(vocabulary, f"block long, part long, found array<{kind}>, texts array<bigint>")
    totals = words.groupBy("part").applyInArrow(total, "block long, part long, df array<bigint>")
    empty = spark.createDataFrame([], schema).toArrow()
    return listed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(weigh, schema)


def top_mean(weights: DataFrame, top_k: int) -> DataFrame:
    """Mean of the ``top_k`` largest weights of a row, of all when it has fewer.

    Rows whose weights sum to less than 1e-6 score 0.
    """
    w = Window.partitionBy("sid").orderBy(F.col("w").desc())
    # Unscaled weights are at least 1, so a row with terms never comes near that
    # sum and the largest few can be cut off before they are shuffled.
    top = weights.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k)
    return top.groupBy("sid").agg(
        F.when(F.sum("w") < 1e-6, 0.0).otherwise(F.avg("w")).alias("score"))


def text_scores(texts: DataFrame, top_k: int, how: Vectorizer) -> DataFrame:
    """``(sid, score)`` for every text, 0 for a text without terms."""
    n, chars, single = _sizes(texts)
    if single:
        def means(sids: pa.Array, of: np.ndarray, found: pa.Array, df: np.ndarray, w: np.ndarray) -> dict:
            order = np.lexsort((-w, of))
            of, w = of[order], w[order]
            texts_of, starts = np.unique(of, return_index=True)
            sums = np.add.reduceat(w, starts)
            top = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)])) < top_k
            score = np.bincount(of, weights=w * top) / np.maximum(np.bincount(of, weights=top), 1)
            return {"sid": sids.take(pa.array(texts_of)), "score": np.where(sums < 1e-6, 0.0, score[texts_of])}
        kind = texts.schema["sid"].dataType.simpleString()
        scored = _in_blocks(texts, how, n, chars, True, means, f"sid {kind}, score double")
    else:
        scored = top_mean(tfidf(texts, how, ids=True), top_k)
    return texts.select("sid").join(scored, "sid", "left").select(
        "sid", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosine distance of paired rows.

    ``left`` and ``right`` hold ``(pair, term, w)`` with unit-length rows; pairs
    are joined on ``(pair, term)``, a key without hot spots.
    """
    both = left.select("pair", "term", F.col("w").alias("a")).join(
        right.select("pair", "term", F.col("w").alias("b")), ["pair", "term"])
    dots = both.groupBy("pair").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    return left.select("pair").distinct().join(dots, "pair", "left").select(
        "pair", (1 - F.coalesce("dot", F.lit(0.0))).alias("distance"))
