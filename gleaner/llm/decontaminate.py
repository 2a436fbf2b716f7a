"""Test items that leaked into training texts, also as edited copies.

Rare word n-grams of the items are seeds, and where a text holds one, the words
around it are aligned with the item by Smith and Waterman's algorithm. Rare is
what the words make of it, not how often the n-gram occurs: a passage that a
third of all texts quote would else hide itself. Word frequencies are counted
over the whole corpus; an n-gram is a seed if its words would meet by chance
at most ``CHANCE`` times, or if it is in the rarer half of its item, so that
each item keeps seeds however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.seeded import lowered_words, reference_words, regions, seeds_of
from gleaner.llm.store import stored
from gleaner.operators.skew import at_most

N = 3
CHANCE = 1.0
SLACK = 12
LEAST = 0.45
"""Least score over the item's length at which a text counts as contaminated."""
LEAST_WORDS = 6
"""Least number of equal words in the alignment; of shorter items all."""
WORD_BLOCK = 1_000_000

_MISMATCH, _GAP = 0.5, 0.5


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """A row for each text and item that match.

    ``docs`` needs ``doc_id, text`` and ``items`` needs ``item_id, text``; other
    columns are ignored. Returns ``doc_id, item_id, score, n_equal, item_words,
    first_word, end_word``: of the best alignment, its score (1 for each equal
    word, less 0.5 for each word changed, put in or left out) over the item's
    words, its equal words, and where it lies in the text, counted in words.
    Case and punctuation don't matter. Items of fewer than ``N`` words, and null
    or empty ones, match nothing; rows that repeat an ``item_id`` are texts of
    the same item, and repeated ``doc_id``s likewise. Rows without an id are left
    out on either side. No items, no rows.
    """
    docs, items = docs.where("doc_id is not null"), items.where("item_id is not null")
    known = stored(reference_words(items, "item_id", N))
    every = seeds_of(known, "item_id")
    seeds = stored(_rare(docs, known, every))
    rows = regions(docs, seeds.withColumn("before", F.col("ref_at")).withColumn("after", F.col("length") - F.col("ref_at") - N), N, SLACK)
    found = stored(rows.withColumn("region", F.xxhash64("doc_id", "at", "words")))
    n_seeds = seeds.count()
    hits = found.select("region", "doc_id", "at", F.explode(F.arrays_zip("hits", "hit_ats")).alias("h"))
    pairs = (hits.select("region", "doc_id", "at", F.col("h.hits").alias("gram"), F.col("h.hit_ats").alias("hit_at"))
             .join(at_most(seeds, n_seeds), "gram")
             .groupBy("region", "doc_id", "at", "item_id", "length")
             .agg(F.min(F.col("hit_at") - F.col("ref_at")).alias("low"), F.max(F.col("hit_at") - F.col("ref_at")).alias("high")))
    sides = (pairs.join(found.select("region", "doc_id", "at", F.col("words").alias("text_words")).distinct(), ["region", "doc_id", "at"])
             .join(at_most(known.select("item_id", F.size("words").alias("length"), F.col("words").alias("item_words")), n_seeds), ["item_id", "length"]))
    cut = F.expr(f"greatest(0, low - at - {SLACK})")
    sides = sides.select("doc_id", "item_id", (F.col("at") + cut).cast("int").alias("at"),
                         F.slice("text_words", cut + 1, F.col("high") - F.col("low") + F.col("length") + 2 * SLACK).alias("text_words"), "item_words")
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    scored = sides.mapInArrow(_align(least), f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, n_equal int, item_words int, first_word int, end_word int")
    best = F.max(F.struct("score", "n_equal", (-F.col("first_word")).alias("_first"), "item_words", "end_word")).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.score", "b.n_equal", "b.item_words", (-F.col("b._first")).alias("first_word"), "b.end_word")


def _rare(docs: DataFrame, known: DataFrame, every: DataFrame) -> DataFrame:
    """The seeds among all n-grams, by word frequencies of the whole corpus."""
    vocabulary = known.select(F.explode("words").alias("word")).distinct()
    counts = stored(_word_counts(docs, vocabulary))
    total = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0] or 1
    placed = known.select("item_id", F.size("words").alias("length"), "words", F.posexplode("words").alias("at", "word"))
    logs = (placed.join(counts.where("word is not null"), "word", "left")
            .select("item_id", "length", "words", "at", F.log(F.coalesce("n", F.lit(1)) / F.lit(float(total))).alias("log_share")))
    following = Window.partitionBy("item_id", "words").orderBy("at").rowsBetween(0, N - 1)
    expected = logs.select("item_id", "length", F.col("at").alias("ref_at"), F.sum("log_share").over(following).alias("log_share")).distinct()
    graded = every.join(expected, ["item_id", "length", "ref_at"])
    middle = graded.groupBy("item_id").agg(F.percentile_approx("log_share", 0.5).alias("middle"))
    return (graded.join(middle, "item_id").where((F.col("log_share") + F.lit(float(np.log(total))) <= float(np.log(CHANCE))) | (F.col("log_share") <= F.col("middle")))
            .select("gram", "item_id", "length", "ref_at").distinct())


def _word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, n`` over all texts, and the number of all words under a null word.

    The vocabulary goes to the tasks in blocks, as seeds do.
    """
    blocks = max(1, -(-vocabulary.count() // WORD_BLOCK))
    texts = docs.select(F.col("text").cast("string"))
    counted = None
    for i in range(blocks):
        part = np.sort(vocabulary.where(F.pmod("word", F.lit(blocks)) == i).toArrow()["word"].to_numpy())
        rows = texts.mapInArrow(_counter(part, i == 0), "word long, n long")
        counted = rows if counted is None else counted.unionByName(rows)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counter(vocabulary: np.ndarray, with_total: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.astype(np.uint64)
        coarse = np.zeros(1 << 22, bool)
        coarse[known >> np.uint64(41)] = True
        counts, total = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for _, _, words in lowered_words(batch.column(0)):
                total += len(words.hashes)
                some = words.hashes[coarse[words.hashes >> np.uint64(41)]]
                if len(some):
                    place = np.minimum(np.searchsorted(known, some), len(known) - 1)
                    counts += np.bincount(place[known[place] == some], minlength=len(known))
        seen = np.flatnonzero(counts)
        words, n = [int(w) for w in known[seen]], [int(c) for c in counts[seen]]
        if with_total:
            words.append(None)
            n.append(total)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])
    return run


def _align(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("doc_id", "item_id", "at")}
            texts = [np.array(x, np.int64) for x in batch.column("text_words").to_pylist()]
            items = [np.array(x, np.int64) for x in batch.column("item_words").to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: (len(items[i]), len(texts[i])))
            rows = []
            for at in range(0, len(order), 256):
                some = order[at: at + 256]
                scores = local_scores([texts[i] for i in some], [items[i] for i in some])
                for i, s in zip(some, scores, strict=True):
                    size = len(items[i])
                    if s >= least * size:
                        equal, first, end = traced(texts[i], items[i])
                        if equal >= min(LEAST_WORDS, size):
                            rows.append((columns["doc_id"][i], columns["item_id"][i], float(s) / size, equal, size, columns["at"][i] + first, columns["at"][i] + end))
            types = [batch.schema.field("doc_id").type, batch.schema.field("item_id").type, pa.float64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                                             names=["doc_id", "item_id", "score", "n_equal", "item_words", "first_word", "end_word"])
    return run


def local_scores(texts: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of many pairs, a row of all their matrices at a time."""
    wide, high = max(map(len, texts)), max(map(len, items))
    across, down = np.full((len(texts), wide), -1, np.int64), np.full((len(items), high), -2, np.int64)
    for k, (t, i) in enumerate(zip(texts, items, strict=True)):
        across[k, : len(t)] = t
        down[k, : len(i)] = i
    ramp = (_GAP * np.arange(wide)).astype(np.float32)
    before = np.zeros((len(texts), wide + 1), np.float32)
    best = np.zeros(len(texts), np.float32)
    for r in range(high):
        step = np.where(across == down[:, r: r + 1], np.float32(1), np.float32(-_MISMATCH))
        now = np.maximum(before[:, :-1] + step, before[:, 1:] - np.float32(_GAP))
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        before[:, 1:] = now
        np.maximum(best, now.max(axis=1), out=best)
    return best


def traced(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Equal words, first and end place in the text of one best local alignment."""
    h = np.zeros((len(item) + 1, len(text) + 1))
    same = item[:, None] == text[None, :]
    ramp = _GAP * np.arange(len(text))
    for r in range(len(item)):
        now = np.maximum(np.maximum(h[r, :-1] + np.where(same[r], 1, -_MISMATCH), h[r, 1:] - _GAP), 0)
        h[r + 1, 1:] = np.maximum.accumulate(now + ramp) - ramp
    i, j = np.unravel_index(h.argmax(), h.shape)
    end, equal = int(j), 0
    while h[i, j] > 1e-9:
        if abs(h[i, j] - h[i - 1, j - 1] - (1 if same[i - 1, j - 1] else -_MISMATCH)) < 1e-9:
            equal += bool(same[i - 1, j - 1])
            i, j = i - 1, j - 1
        elif abs(h[i, j] - h[i - 1, j] + _GAP) < 1e-9:
            i -= 1
        else:
            j -= 1
    return equal, int(j), end
