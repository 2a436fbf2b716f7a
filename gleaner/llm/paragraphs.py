"""Paragraphs that occur again, exactly or nearly, in the same or other documents.

A paragraph is a line of at least ``LEAST_WORDS`` words. Equal word sequences
form a class, which goes on as its first paragraph. Classes get a MinHash
signature of their five-word shingles, cut into ``BANDS`` bands of ``ROWS``
values: two paragraphs of similarity 0.75 share a band with a probability of
1 - (1 - 0.75 ** 2) ** 12, about 0.99995. Paragraphs that share a band are
compared on their full shingle sets, hub by hub, and all but the first of each
connected component are removed.

What then stays is searched for passages: runs of ``PASSAGE`` equal words or
more, in the middle of longer lines and across line ends too. Such a run always
holds a winnowed n-gram of half its length. Where one occurs again, the windows of
``PASSAGE`` words around it are counted, and all but the first of each are removed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.components import jaccard_links, parts_by_hubs
from gleaner.llm.store import stored
from gleaner.llm.words import Texts, Words, list_array, long_ngrams, mixed, ngrams, text_blocks, words_of

LEAST_WORDS = 20
SHINGLE = 5
SIMILAR = 75
BANDS, ROWS = 12, 2
PASSAGE = 50
"""Least number of equal words in a row that make a passage, wherever lines end."""
_LINES = 10 ** 10
"""More than a text has lines; a paragraph's id is its document's times this, plus its line."""


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, similar: int = SIMILAR) -> DataFrame:
    """A row for each paragraph that has a near copy.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns
    ``doc_id, line, n_words, first_doc_id, first_line, removed``: the first
    paragraph of its component by document and line, and whether it is another.

    Words are lower-cased in A-Z and end at white space. Null and empty texts
    have no paragraphs, and rows without ``doc_id`` are left out. Rows that
    repeat a ``doc_id`` with an equal text are the same paragraphs and appear once.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The row number is fixed once the table is written; it stands for the paragraph in all that follows.
    rows = stored(texts.mapInArrow(
        _scanner(least_words), "doc_id long, line int, n_words int, key_a long, key_b long, bands array<long>")
        .withColumn("row", F.monotonically_increasing_id()))
    own = _id("doc_id", "line")
    firsts = stored(rows.select("row", "n_words", "key_a", "key_b", own.alias("id")).groupBy("key_a", "key_b").agg(
        F.min("id").alias("id"), F.max("id").alias("last"), F.min_by("row", "id").alias("row"), F.min("n_words").alias("n_words")))
    posts = (rows.select("row", "bands", (F.col("n_words") - (SHINGLE - 1)).cast("long").alias("n")).join(firsts.select("row"), "row", "left_semi")
             .select(F.col("row").alias("id"), "n", F.explode("bands").alias("v")))
    shared = posts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    keys = stored(posts.join(shared, "v").select("v", "id", "n"))
    sets = _sets_of(texts, firsts, keys, least_words)
    found = parts_by_hubs(keys, lambda pairs: jaccard_links(pairs, sets, similar), sets, similar)

    linked = firsts.select("row", "id").join(found, F.col("row") == F.col("node"))
    first_of = linked.groupBy("component").agg(F.min("id").alias("first"))
    moved = linked.select("row", "component").join(first_of, "component").select("row", "first")
    known = (firsts.join(moved, "row", "left").where("last > id or first is not null")
             .select("key_a", "key_b", F.coalesce("first", "id").alias("first")))
    return (rows.select("doc_id", "line", "n_words", "key_a", "key_b").join(known, ["key_a", "key_b"])
            .select("doc_id", "line", "n_words", _doc("first").alias("first_doc_id"),
                    _line("first").alias("first_line"), (own != F.col("first")).alias("removed")).distinct())


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the removed paragraphs of ``repeats`` taken out of ``text``.

    A text that loses all its lines is left empty; a null text stays null.
    """
    cuts = found.where("removed").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line").alias("_cut"))
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (l, i) -> not array_contains(_cut, i)), '\\n')")
    return (docs.join(cuts, F.col("doc_id") == F.col("_id"), "left")
            .withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept)).drop("_id", "_cut"))


def passages(docs: DataFrame, found: DataFrame, least: int = PASSAGE) -> DataFrame:
    """A row for each run of ``least`` words or more that stands earlier in what ``repeats`` leaves.

    ``found`` is the result of ``repeats`` for ``docs``. Has its columns and
    ``word, end_line, first_word``: the run starts at word ``word`` of ``line``,
    counted from 0, has ``n_words`` words and ends in ``end_line``; its first
    copy starts at word ``first_word`` of ``first_line``. Windows of ``least`` words
    are compared, and of each the first by document and place stays. A copy in the same
    document counts if it does not overlap the first. Runs whose first copies are in
    different documents are rows of their own and may overlap.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gone = stored(found.where("removed").select("doc_id", "line").distinct())
    cut = stored(gone.groupBy("doc_id").agg(F.collect_list("line").alias("cut")))
    # Marks go packed, a row for each text, until they are counted.
    kept = "if(cut is null, marks, filter(marks, (m, i) -> not array_contains(cut, lines[i])))"
    marks = (stored(texts.mapInArrow(_marks(least), "doc_id long, lines array<int>, marks array<long>").join(cut, "doc_id", "left")
                    .select("doc_id", F.expr(kept).alias("marks"))).select("doc_id", F.explode("marks").alias("mark")))
    # Stored, and what follows the join deals its rows out anew, so Spark may split a mark that many documents hold.
    shared = stored(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mark"))
    wanted = marks.join(shared, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))
    wanted = stored(wanted.join(cut, "doc_id", "left").select("doc_id", "marks", F.coalesce("cut", F.array().cast("array<int>")).alias("cut")))
    windows = stored(texts.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", F.xxhash64("text").alias("content"), "text", "marks", "cut")
                     .mapInArrow(_windows(least), "doc_id long, content long, at int, line int, word int, end_line int, window long"))

    place = F.struct("doc_id", "content", "at", "line", "word")
    # Stored, so that Spark may split a window that many documents hold.
    firsts = stored(windows.groupBy("window").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f < l").select("window", "f"))
    again = windows.join(firsts, "window").where(f"doc_id <> f.doc_id or content <> f.content or at >= f.at + {least}")
    # Rows of one place are equal and stay in one run. Of a run the first and the last window are kept, next to each other.
    order = Window.partitionBy("doc_id", "content").orderBy("at")
    starts = F.coalesce((F.col("at") > F.lag("at").over(order) + least) | (F.lag("f.doc_id").over(order) != F.col("f.doc_id")), F.lit(True))
    rims = (again.withColumn("starts", starts).withColumn("ends", F.coalesce(F.lead("starts").over(order), F.lit(True))).where("starts or ends"))
    last = F.struct("at", "end_line")
    runs = rims.withColumn("z", F.when(F.col("ends"), last).otherwise(F.lead(last).over(order))).where("starts")
    return runs.select("doc_id", "line", (F.col("z.at") + least - F.col("at")).alias("n_words"), F.col("f.doc_id").alias("first_doc_id"),
                       F.col("f.line").alias("first_line"), F.lit(True).alias("removed"), "word", "z.end_line", F.col("f.word").alias("first_word")).distinct()


def all_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``repeats`` and ``passages``; a whole line starts and its first copy starts at word 0."""
    found = stored(repeats(docs))
    lines = found.withColumns({"word": F.lit(0), "end_line": F.col("line"), "first_word": F.lit(0)})
    return lines.unionByName(passages(docs, found))


def without_all(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with what ``all_repeats`` found taken out of ``text``, and the lines that lose all their words."""
    cuts = (found.where("removed").groupBy(F.col("doc_id").alias("_id"))
            .agg(F.collect_set(F.struct("line", "word", "n_words")).alias("_cut")))
    return (docs.join(cuts, F.col("doc_id") == F.col("_id"), "left")
            .withColumn("text", F.udf(_without, "string")("text", "_cut")).drop("_id", "_cut"))


def _without(text, cuts):
    if text is None or cuts is None:
        return text
    lines = text.split("\n")
    words = [(k, m.start(), m.end()) for k, line in enumerate(lines) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
    begins: dict[int, int] = {}
    for i, (k, _, _) in enumerate(words):
        begins.setdefault(k, i)
    gone = {i for line, word, n in cuts if line in begins for i in range(begins[line] + word, begins[line] + word + n)}
    kept: dict[int, list[str]] = {}
    at = 0
    for i, (k, first, end) in enumerate(words):
        at = 0 if i == begins[k] else at
        if i in gone:
            kept.setdefault(k, [])
        else:
            kept.setdefault(k, []).append(lines[k][at if at < first else first: end])
        at = end
    touched = {words[i][0] for i in gone if i < len(words)}
    return "\n".join("".join(kept[k]) if k in touched else line for k, line in enumerate(lines) if k not in touched or kept[k])


def _id(doc: str, line: str) -> Column:
    return (F.col(doc).cast("decimal(20,0)") * F.lit(_LINES) + F.col(line)).cast("decimal(38,0)")


def _line(paragraph: str) -> Column:
    return F.pmod(F.col(paragraph), F.lit(_LINES)).cast("int")


def _doc(paragraph: str) -> Column:
    return ((F.col(paragraph) - _line(paragraph)) / _LINES).cast("long")


def _sets_of(texts: DataFrame, firsts: DataFrame, keys: DataFrame, least_words: int) -> DataFrame:
    """``id, full``: the shingles of the paragraphs in ``keys``.

    Texts meet the wanted documents by a shuffle at every size, so that what
    this takes grows evenly with the corpus.
    """
    ids = (firsts.select(_doc("id").alias("doc_id"), F.struct(_line("id").alias("line"), F.col("row").alias("id")).alias("p"), F.col("row").alias("id"))
           .join(keys.select("id").distinct(), "id", "left_semi"))
    wanted = stored(ids.groupBy("doc_id").agg(F.collect_list("p").alias("p")).select("doc_id", F.col("p.line").alias("lines"), F.col("p.id").alias("ids")))
    return stored(texts.join(wanted.hint("shuffle_hash"), "doc_id").select("text", "lines", "ids")
                  .mapInArrow(_sets(least_words), "id long, full array<long>"))


def _lines(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word at or after the start of each line of a block, and the first line of each text."""
    starts = np.union1d(texts.bounds[:-1], np.flatnonzero(texts.data == 10) + 1)
    return np.searchsorted(words.starts, starts), np.searchsorted(starts, texts.bounds[:-1])


def _placed(words: Words, lines: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of the words at some places, and their line in it."""
    text = np.searchsorted(words.first, at, "right") - 1
    return text, np.searchsorted(lines[0], at, "right") - 1 - lines[1][text]


def _paragraphs(words: Words, lines: tuple[np.ndarray, np.ndarray], least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, line number, first and end word of each paragraph of enough words."""
    edges = np.append(np.unique(lines[0][lines[0] < len(words.hashes)]), len(words.hashes))
    first, end = edges[:-1], edges[1:]
    full = end - first >= least_words
    first, end = first[full], end[full]
    return *_placed(words, lines, first), first, end


def _scanner(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = mixed(np.arange(2 * BANDS * ROWS, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                words = words_of(texts, lower=True)
                text, line, first, end = _paragraphs(words, _lines(texts, words), least_words)
                if not len(text):
                    continue
                hashes, grams = words.hashes, ngrams(words.hashes, SHINGLE)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
                turns = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.arange(len(hashes), dtype=np.uint64))])
                total = sums[end] - sums[first]
                key_a = mixed(total)
                # Each word counts 2 k + 3 times, k being its place in the paragraph.
                key_b = np.uint64(2) * (turns[end] - turns[first] - first.astype(np.uint64) * total) + np.uint64(3) * total
                # Word ranges of the paragraphs, one after the other, and the last shingle of each.
                cuts = np.empty(2 * len(first), np.int64)
                cuts[::2], cuts[1::2] = first, np.maximum(first + 1, end - SHINGLE + 1)
                padded = np.append(grams, np.full(SHINGLE, np.iinfo(np.int64).max, np.uint64))
                lows = np.empty((BANDS * ROWS, len(first)), np.uint64)
                for i in range(BANDS * ROWS):
                    values = padded * spread[2 * i] + spread[2 * i + 1]
                    lows[i] = np.minimum.reduceat(values, cuts)[::2]
                bands = np.zeros((BANDS, len(first)), np.uint64)
                for i in range(BANDS * ROWS):
                    bands[i // ROWS] = mixed(bands[i // ROWS] + lows[i] + np.uint64(i))
                flat = pa.array((bands.T.ravel() >> np.uint64(1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(texts.first_row + text)), pa.array(line.astype(np.int32)), pa.array((end - first).astype(np.int32)),
                     pa.array((key_a >> np.uint64(1)).astype(np.int64)), pa.array((key_b >> np.uint64(1)).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(first) + 1, BANDS, dtype=np.int32)), flat)],
                    names=["doc_id", "line", "n_words", "key_a", "key_b", "bands"])
    return run


def _sets(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(0)):
                words = words_of(texts, lower=True)
                text, line, first, end = _paragraphs(words, _lines(texts, words), least_words)
                of, wanted = _listed(batch.column(1), texts)
                ids = _listed(batch.column(2), texts)[1]
                # Paragraphs are in order of text and line; the wanted ones are looked up among them.
                have, ask = text * _LINES + line, of * _LINES + wanted
                at = np.searchsorted(have, ask)
                held = np.append(have, -1)[at] == ask
                at, ids = at[held], ids[held]
                grams = ngrams(words.hashes, SHINGLE)
                sets = [grams[a: b - SHINGLE + 1] for a, b in zip(first[at].tolist(), np.maximum(end, first + SHINGLE)[at].tolist(), strict=True)]
                sets = [np.sort(x) for x in sets]
                sets = [x if len(x) < 2 or (x[1:] > x[:-1]).all() else np.unique(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(sets, pa.int64())], names=["id", "full"])
    return run


def _listed(column: pa.Array, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """What the lists of a block's rows hold: the text each value belongs to, and the values."""
    lists = column.slice(texts.first_row, len(texts))
    return np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()


def _slid(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` over each ``width`` neighbours."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values, span = pick(values[:-step], values[step:]), span + step
    return values


def _winnowed(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of half of ``least`` words, the least in each run of ``least`` words, or 0 where a text ends in it, and the places of these."""
    n = least // 2
    if len(words.hashes) < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, width = long_ngrams(words.hashes, n), least - n + 1
    low = _slid(grams, width, np.minimum)
    for end in words.first[1:]:  # no run crosses the end of a text
        low[max(0, end - least + 1): end] = 0
    rim = np.zeros(width - 1, np.uint64)
    top = _slid(np.concatenate([rim, low, rim]), width, np.maximum)
    return grams, low, np.flatnonzero((top == grams) & (top > 0))


def _marks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                words = words_of(texts, lower=True)
                grams, _, at = _winnowed(words, least)
                text, line = _placed(words, _lines(texts, words), at)
                # Words that go round give one mark over and over; two of it in a line say that it is shared.
                keep = np.ones(len(at), bool)
                keep[2:] = (text[2:] != text[:-2]) | (line[2:] != line[:-2]) | (grams[at[2:]] != grams[at[1:-1]]) | (grams[at[2:]] != grams[at[:-2]])
                at, line = at[keep], line[keep]
                cuts = pa.array(np.searchsorted(at, words.first).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (line.astype(np.int32), grams[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first_row, len(texts)), *lists], names=["doc_id", "lines", "marks"])
    return run


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(2)):
                words = words_of(texts, lower=True)
                grams, low, chosen = _winnowed(words, least)
                marks = np.unique(_listed(batch.column(3), texts)[1]).astype(np.uint64)  # a mark that one text has to look for is shared for all
                near = chosen[np.isin(grams[chosen], marks)]
                if not len(near):
                    continue
                n = len(words.hashes) + 1
                edges = np.bincount(np.maximum(near - (least - least // 2), 0), minlength=n) - np.bincount(near + 1, minlength=n)
                at = np.flatnonzero(np.cumsum(edges)[: len(low)] > 0)  # windows that hold a shared n-gram
                at = at[np.isin(low[at], marks)]  # in copies of a window the same n-gram is the least
                first, of_text = lines = _lines(texts, words)
                text, gone = _listed(batch.column(4), texts)
                gone = of_text[text] + gone
                gone = gone[gone < np.append(of_text[1:], len(first))[text]]
                cut = np.zeros(n, np.int64)
                np.add.at(cut, first[gone], 1)
                np.add.at(cut, np.append(first, n - 1)[gone + 1], -1)
                cut = np.concatenate([[0], np.cumsum(np.cumsum(cut) > 0)])
                at = at[cut[at + least] == cut[at]]
                text, line = _placed(words, lines, at)
                rows = pa.array(texts.first_row + text)
                ints = [at - words.first[text], line, at - first[of_text[text] + line], _placed(words, lines, at + least - 1)[1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(rows) for c in (0, 1)] + [pa.array(x.astype(np.int32)) for x in ints]
                    + [pa.array(long_ngrams(words.hashes, least)[at].astype(np.int64))],
                    names=["doc_id", "content", "at", "line", "word", "end_line", "window"])
    return run
