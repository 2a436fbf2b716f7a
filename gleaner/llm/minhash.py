"""Near-duplicates from bottom-k sketches of word shingles.

One hash function orders all shingles, and a document's sketch is its ``k``
smallest hashes. Documents with the same set of shingles form a class, and only
its smallest id goes on. Inverted lists of the retained values then say which
classes share how many of them:

* two linked sets share a number of retained values that follows from the
  similarity (``_need``), so a class with fewer values on any list with others
  has no partner;
* of the others, only the rarest values must be looked up: two sketches that
  share ``m`` of ``k`` values also share one of their ``k - m + 1`` rarest.
  Values of a passage that everybody quotes come last and mostly aren't used.

Within a list all pairs are never formed. Each member is compared with a hub of
its list; members that verify are in one component, and what remains to be
compared is only what the components so far leave apart (``parts_by_hubs``), so
no link is lost. A candidate is first judged on the sketch of the union, then on
the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.components import jaccard_links, parts_by_hubs
from gleaner.llm.store import stored
from gleaner.llm.words import list_array, ngrams, shingle_set, text_blocks, words_of
from gleaner.operators.skew import at_most

K = 96
SHINGLE = 5
SIMILAR = 75
"""Least similarity in per cent."""
SPREADS = 5
"""Standard deviations by which an estimate from sketches may miss what it must reach."""


def near_duplicates(docs: DataFrame, k: int = K, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Component and survivor of each document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a
    row for each input row: ``doc_id, n_shingles, component_id, kept``.

    Words are lower-cased in A-Z and end at white space. Null, empty and blank
    texts have an empty set, are linked with nothing and are their own
    component. Texts of fewer than ``shingle`` words have one shingle, the whole
    sequence. Rows that repeat a ``doc_id`` are the same document: their texts
    share a component. A row without ``doc_id`` is linked with nothing, has a
    null component and is kept.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                  .mapInArrow(_sketcher(k, shingle), "doc_id long, n_shingles long, key_a long, key_b long, sketch array<long>"))
    classes = stored(rows.where("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b")
                     .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = stored(rows.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "key_a", "key_b"], "left_semi")
                  .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch"))
    keys = stored(_lookup_keys(reps, k, similar))
    found = _components(keys, reps, docs, k, shingle, similar)

    known = (classes.join(found, F.col("rep") == F.col("node"), "left")
             .where("copies > 1 or component is not null")
             .select("key_a", "key_b", F.coalesce("component", "rep").alias("component")))
    own = F.coalesce("component", "doc_id")
    return (rows.select("doc_id", "n_shingles", "key_a", "key_b")
            .join(known, ["key_a", "key_b"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
                    F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept")))


def _sketcher(k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                words = words_of(texts, lower=True)
                grams = ngrams(words.hashes, shingle)
                sets = [shingle_set(words, grams, i, shingle) for i in range(len(texts))]
                key_a = [int(s.sum(dtype=np.uint64)) >> 1 for s in sets]
                key_b = [int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15))) >> 1 if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first_row, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(key_a, pa.int64()), pa.array(key_b, pa.int64()), list_array([s[:k] for s in sets], pa.int64())],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "sketch"])
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                words = words_of(texts, lower=True)
                grams = ngrams(words.hashes, shingle)
                sets = [shingle_set(words, grams, i, shingle) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first_row, len(texts)), list_array(sets, pa.int64())], names=["id", "full"])
    return run


def _need(n: Column, k: int, similar: int) -> Column:
    """Values that the sketch of a set of ``n`` shares with that of any linked set, but for one case in millions.

    Of the ``k`` least values of the union, a share of ``similar`` lies in both
    sets, with the spread of a draw without replacement from a union of at most
    ``n / similar``; ``SPREADS`` times that is taken off. Sets that fit their
    sketch have no spread.
    """
    share = similar / 100
    spread = F.sqrt(share * (1 - share) * k * F.greatest(F.lit(0.0), 1 - share * k / n))
    return F.greatest(F.lit(1), F.ceil(share * F.least(n, F.lit(k)) - SPREADS * spread - 1e-9)).cast("int")


def _lookup_keys(reps: DataFrame, k: int, similar: int) -> DataFrame:
    """``(v, id, n)``: the rarest shared values by which a class must be looked up."""
    posts = reps.select("id", "n", F.explode("sketch").alias("v"))
    lists = posts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = (posts.join(lists, "v").groupBy("id", "n").agg(F.collect_list(F.struct("c", "v")).alias("m"))  # at most k values
              .where(F.size("m") >= _need(F.col("n"), k, similar)))
    rarest = F.slice(F.sort_array("m"), 1, F.size("m") - _need(F.col("n"), k, similar) + 1)
    return shared.select("id", "n", F.explode(rarest).alias("e")).select("e.v", "id", "n")


def _components(keys: DataFrame, reps: DataFrame, docs: DataFrame, k: int, shingle: int, similar: int) -> DataFrame:
    """``(node, component)`` of whatever is linked."""
    ids = stored(keys.select("id").distinct())
    wanted = at_most(ids, ids.count())
    sets = stored(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
                  .join(wanted, "id").select("id", "text")
                  .mapInArrow(_sets(shingle), "id long, full array<long>"))
    sketches = reps.join(wanted, "id").select("id", "n", "sketch")

    return parts_by_hubs(keys, lambda pairs: _verified(pairs, sketches, sets, k, similar), sets, similar)


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, k: int, similar: int) -> DataFrame:
    """The pairs that pass on the sketch of the union and then on the full sets."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    likely = stored(both.where(common >= F.greatest(_need(F.col("na"), k, similar), _need(F.col("nb"), k, similar))).select("a", "b"))
    return jaccard_links(likely, sets, similar)
