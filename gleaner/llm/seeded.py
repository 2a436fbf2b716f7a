"""Places of long texts that share n-grams with a much smaller set of references.

The n-grams of the references are the seeds. Texts are scanned for them where
they lie; only the neighbourhood of a hit leaves the scan, so the words of the
corpus are neither shuffled nor stored. Seeds go to the tasks in blocks of
``SEED_BLOCK``: more seeds take more scans, not more memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import SEPARATORS, Words, list_array, ngrams, text_blocks, words_of

SEED_BLOCK = 2_000_000
SPAN = 256
"""Most words between the first and the last hit of a region."""
GAP = 48
"""Hits of a region lie closer than this."""

Chooser = Callable[[np.ndarray, Words], np.ndarray]


def reference_words(references: DataFrame, key: str, n: int, choose: Chooser | None = None) -> DataFrame:
    """``key``, ``words`` and their ``grams``: hashes of each n-gram, null where ``choose`` leaves it out.

    Texts are lower-cased and words are runs of letters and digits. References
    with fewer than ``n`` words, null ones too, have no n-gram and are left out.
    """
    kind = dict(references.dtypes)[key]
    rows = references.select(key, F.col("text").cast("string")).mapInArrow(
        _reference_scan(n, choose), f"{key} {kind}, words array<long>, grams array<long>")
    return rows.where(f"size(words) >= {n}").distinct()


def seeds_of(references: DataFrame, key: str) -> DataFrame:
    """A row for each n-gram of ``reference_words``: ``gram``, ``key``, ``ref_at`` and the reference's ``length``."""
    return (references.select(key, F.size("words").alias("length"), F.posexplode("grams").alias("ref_at", "gram"))
            .where("gram is not null"))


def regions(docs: DataFrame, seeds: DataFrame, n: int, slack: int, choose: Chooser | None = None,
            block: int = SEED_BLOCK) -> DataFrame:
    """Neighbourhoods of the seeds in ``docs`` (``doc_id, text``).

    ``seeds`` has ``gram``, and ``before`` and ``after``: how many words the
    references reach to either side of it; ``slack`` words are added. Returns
    ``doc_id, at, words, hits, hit_ats``: words from place ``at`` of the text on, and the
    seeds in them by place. Texts without a hit give no row.
    """
    one = seeds.groupBy("gram").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    blocks = -(-one.count() // block)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, at int, words array<long>, hits array<long>, hit_ats array<int>"
    texts = docs.select("doc_id", F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], schema)
    for i in range(blocks):
        part = one.where(F.pmod("gram", F.lit(blocks)) == i).toArrow()  # about `block` rows
        order = np.argsort(part["gram"].to_numpy())
        table = [part[c].to_numpy()[order] for c in ("gram", "before", "after")]
        scanned = texts.mapInArrow(_scan(table, n, slack, choose), schema)
        found = scanned if not i else found.unionByName(scanned)
    return found


def lowered_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """First row, number of rows and words of each block of a text column."""
    for texts in text_blocks(pc.utf8_lower(column.cast(pa.large_string()))):
        words = words_of(texts, breaks=SEPARATORS)
        words.hashes >>= np.uint64(1)
        yield texts.first_row, len(texts), words


def winnowed(window: int) -> Chooser:
    """Keep each n-gram that is the least of some ``window`` neighbours in its text; all of a shorter text."""
    def choose(grams: np.ndarray, words: Words) -> np.ndarray:
        kept = np.zeros(len(grams), bool)
        if len(grams) >= window:
            views = [grams[k: len(grams) - window + 1 + k] for k in range(window)]
            least = np.minimum.reduce(views)
            for k, v in enumerate(views):
                kept[k: k + len(v)] |= v == least
        short = np.flatnonzero(np.diff(words.first) < 2 * window + 8)  # windows may cross the ends of texts: keep these whole
        for i in short:
            kept[words.first[i]: words.first[i + 1]] = True
        edges = words.first[1:-1]
        for k in range(-2 * window, window):
            at = edges + k
            kept[at[(at >= 0) & (at < len(kept))]] = True
        return kept
    return choose


def _reference_scan(n: int, choose: Chooser | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, size, words in lowered_words(batch.column(1)):
                grams = ngrams(words.hashes, n)
                kept = choose(grams, words) if choose else np.ones(len(grams), bool)
                spans = [(words.first[i], words.first[i + 1]) for i in range(size)]
                rows = [[int(g) if k else None for g, k in zip(grams[a: b - n + 1], kept[a: b - n + 1], strict=True)]
                        if b - a >= n else [] for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first_row, size), list_array([words.hashes[a:b] for a, b in spans], pa.int64()),
                     pa.array(rows, pa.list_(pa.int64()))], names=[batch.schema.names[0], "words", "grams"])
    return run


def _scan(table: list[np.ndarray], n: int, slack: int, choose: Chooser | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, before, after = table
        seeds = seeds.astype(np.uint64)
        # A bitmap of the top 22 bits settles most n-grams; seeds stay below 2**63.
        coarse = np.zeros(1 << 22, bool)
        coarse[seeds >> np.uint64(41)] = True
        for batch in batches:
            for first_row, size, words in lowered_words(batch.column(1)):
                grams = ngrams(words.hashes, n)
                at = np.flatnonzero(coarse[grams >> np.uint64(41)])
                place = np.minimum(np.searchsorted(seeds, grams[at]), len(seeds) - 1)
                same = seeds[place] == grams[at]
                at, place = at[same], place[same]
                text = np.searchsorted(words.first, at, "right") - 1
                within = at + n <= words.first[text + 1]
                if choose:
                    within &= choose(grams, words)[at]
                at, place, text = at[within], place[within], text[within]
                if not len(at):
                    continue
                fresh = np.ones(len(at), bool)
                fresh[1:] = (np.diff(text) > 0) | (np.diff(at) > GAP)
                start = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
                fresh[1:] |= np.diff((at - start) // SPAN) != 0
                edges = np.append(np.flatnonzero(fresh), len(at))
                a, b, base = edges[:-1], edges[1:], words.first[text[edges[:-1]]]
                low = np.maximum(base, np.minimum.reduceat(at - before[place], a) - slack)
                high = np.minimum(words.first[text[a] + 1], np.maximum.reduceat(at + n + after[place], a) + slack)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first_row + text[a])), pa.array((low - base).astype(np.int32)),
                     list_array([words.hashes[x:y] for x, y in zip(low, high, strict=True)], pa.int64()),
                     list_array([grams[at[x:y]] for x, y in zip(a, b, strict=True)], pa.int64()),
                     list_array([at[x:y] - s for x, y, s in zip(a, b, base, strict=True)], pa.int32())],
                    names=["doc_id", "at", "words", "hits", "hit_ats"])
    return run
