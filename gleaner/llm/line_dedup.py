"""Lines that documents share in the same order, deleted from the later one.

Each document's lines are hashed. A seed is a line, or as many lines in a row as
it takes to reach ``LEAST_CHARS`` characters, so that it is rare by what it says
and a short common line alone points nowhere. Every document is linked with the
earliest document that holds one of its seeds, never with all of them: a seed
that a third of all documents share makes one pair for each. Linked documents
are aligned by patience diff on the line hashes, and blocks of equal lines of at
least ``LEAST_CHARS`` characters are deleted from the document with the larger id.

Alignment passes over lines that stand in another order or more than once. So each
seed that an earlier document holds is then deleted wherever it stands
(``every_shared``). For this, seeds also end at each line, so that they cover
every run of ``LEAST_CHARS`` characters to its last line.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.store import stored
from gleaner.llm.words import Texts, list_array, mixed, spans_hashed, text_blocks

LEAST_CHARS = 60
REMOVED = "_gl_removed_lines"


def shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, n_lines, removed``: numbers, from 0, of the lines to delete from each document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Lines end
    at line feeds and are compared byte by byte. Null and empty texts have no
    lines. A row without ``doc_id`` loses nothing. Rows that repeat a ``doc_id``
    are aligned each, and none of them with another of the same id.
    """
    lines = stored(docs.select(F.col("doc_id").cast("long"), _content(), F.col("text").cast("string")).mapInArrow(
        _scan(least_chars), "doc_id long, content long, hashes array<long>, chars array<int>, seeds array<long>"))
    posts = lines.where("doc_id is not null").select("doc_id", F.explode("seeds").alias("seed")).distinct()
    firsts = posts.groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("seed", "first")
    pairs = stored(posts.join(firsts, "seed").where("doc_id <> first").select("doc_id", "first").distinct())

    later = lines.select("doc_id", "content", "hashes", "chars").join(pairs, "doc_id")
    earlier = lines.select(F.col("doc_id").alias("first"), F.col("hashes").alias("first_hashes"))
    common = later.join(earlier, "first").select("doc_id", "content", "hashes", "chars", "first_hashes").mapInArrow(
        _align(least_chars), "doc_id long, content long, removed array<int>")
    removed = common.groupBy("doc_id", "content").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))
    return (lines.select("doc_id", "content", F.size("hashes").cast("long").alias("n_lines")).join(removed, ["doc_id", "content"], "left")
            .select("doc_id", "content", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")))


def every_shared(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``shared_lines`` and, beside it, every run of lines of ``least_chars`` characters that an earlier document holds.

    Of such a run all copies go, in any order and number. Blank lines don't count
    when runs are compared; those inside a shortest run that starts or ends at a line go with
    it, others may stay. The earliest document that holds a line keeps it.
    """
    lines = stored(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), _content(), F.col("text").cast("string")).mapInArrow(
        _scan_runs(least_chars), "doc_id long, content long, seed long, start int, end int"))
    firsts = lines.groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("seed", "first")
    runs = (lines.join(firsts, "seed").where("doc_id <> first").groupBy("doc_id", "content")
            .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("end") - 1)))).alias("again")))
    return (shared_lines(docs, least_chars).join(runs, ["doc_id", "content"], "left")
            .select("doc_id", "content", "n_lines", F.when(F.col("again").isNull(), F.col("removed")).otherwise(
                F.array_sort(F.array_union("removed", "again"))).alias("removed")))


def without_shared(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``shared_lines`` found taken out of ``text``.

    Their number is in a column named by ``REMOVED``. A text that loses all its
    lines is left empty; a null text stays null.
    """
    cuts = (found.where("size(removed) > 0").groupBy(F.col("doc_id").alias("_gl_id"), F.col("content").alias("_gl_content"))
            .agg(F.first("removed").alias("_gl_cut")))
    left = docs.withColumn("_gl_id", F.col("doc_id").cast("long")).withColumn("_gl_content", _content())
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (line, i) -> not array_contains(_gl_cut, i)), '\\n')")
    return (left.join(cuts, ["_gl_id", "_gl_content"], "left")
            .withColumn("text", F.when(F.col("_gl_cut").isNull(), F.col("text")).otherwise(kept))
            .withColumn(REMOVED, F.coalesce(F.size("_gl_cut"), F.lit(0)).cast("long")).drop("_gl_id", "_gl_content", "_gl_cut"))


def _content() -> Column:
    """Tells texts of rows with the same id apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("content")


def _scan(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(2)):
                rows = slice(texts.first_row, texts.first_row + len(texts))
                hashes, chars, seeds = _lines(texts, least_chars)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], list_array(hashes, pa.int64()), list_array(chars, pa.int32()),
                     list_array(seeds, pa.int64())], names=["doc_id", "content", "hashes", "chars", "seeds"])
    return run


def _lines(texts: Texts, least_chars: int) -> tuple[list, list, list]:
    """Line hashes, characters and distinct seeds of each text."""
    data, bounds = texts.data, texts.bounds
    solid = np.flatnonzero(np.diff(bounds))  # texts with lines
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[solid], feeds + 1]))
    stops = np.sort(np.concatenate([bounds[solid + 1], feeds]))
    feeds_of = np.searchsorted(bounds[solid + 1], feeds, "right")
    text_of = np.repeat(np.arange(len(solid)), np.bincount(feeds_of, minlength=len(solid)) + 1)
    hashes = spans_hashed(data, starts, stops) >> np.uint64(1)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = letters[stops] - letters[starts]

    full = np.flatnonzero(chars)
    total = np.concatenate([[0], np.cumsum(chars[full])])
    end = np.searchsorted(total, total[:-1] + least_chars, "left")  # lines full[i:end[i]] reach the length
    seed, active = np.zeros(len(full), np.uint64), np.arange(len(full))[end <= len(full)]
    active = active[text_of[full[active]] == text_of[full[end[active] - 1]]]
    begun = active
    step = 0
    while len(active):
        seed[active] = mixed(seed[active] + hashes[full[active + step]])
        step += 1
        active = active[active + step < end[active]]

    at = np.searchsorted(text_of, np.arange(len(solid) + 1))
    seed_text, seed = text_of[full[begun]], seed[begun] >> np.uint64(1)
    seed_at = np.searchsorted(seed_text, np.arange(len(solid) + 1))
    none = np.zeros(0, np.uint64)
    out: tuple[list, list, list] = ([none] * len(texts), [none] * len(texts), [none] * len(texts))
    for k, i in enumerate(solid):
        out[0][i], out[1][i] = hashes[at[k]: at[k + 1]], chars[at[k]: at[k + 1]]
        out[2][i] = np.unique(seed[seed_at[k]: seed_at[k + 1]])
    return out


def _scan_runs(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(2)):
                hashes, chars, _ = _lines(texts, least_chars)
                sizes = [len(h) for h in hashes]
                text, at, end, seed = _runs(np.concatenate(hashes).astype(np.uint64), np.concatenate(chars).astype(np.int64), np.array(sizes), least_chars)
                rows = pa.array(texts.first_row + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(seed.astype(np.int64)), pa.array(at.astype(np.int32)),
                     pa.array(end.astype(np.int32))], names=["doc_id", "content", "seed", "start", "end"])
    return run


def _runs(hashes: np.ndarray, chars: np.ndarray, sizes: np.ndarray, least_chars: int) -> tuple[np.ndarray, ...]:
    """Text, first and end line, and hash of each shortest run that starts or ends at a line and has the characters."""
    text_of, base = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    full = np.flatnonzero(chars)
    total = np.concatenate([[0], np.cumsum(chars[full])])
    ahead = np.searchsorted(total, total[:-1] + least_chars, "left")
    back = np.searchsorted(total, total[1:] - least_chars, "right") - 1
    each = np.arange(len(full))
    first, end = np.concatenate([each, np.maximum(back, 0)]), np.concatenate([ahead, each + 1])
    kept = (end <= len(full)) & np.concatenate([np.full(len(full), True), back >= 0])
    first, end = first[kept], end[kept]
    same = text_of[full[first]] == text_of[full[end - 1]]
    first, end = np.unique(np.stack([first[same], end[same]], axis=1), axis=0).T
    seed, active, step = np.zeros(len(first), np.uint64), np.arange(len(first)), 0
    while len(active):
        seed[active] = mixed(seed[active] + hashes[full[first[active] + step]])
        step += 1
        active = active[first[active] + step < end[active]]
    text = text_of[full[first]]
    return text, full[first] - base[text], full[end - 1] + 1 - base[text], seed >> np.uint64(1)


def _align(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (batch.column(c).to_pylist() for c in ("hashes", "chars", "first_hashes"))
            removed = [common_blocks(h, c, f, least_chars) for h, c, f in zip(*lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(removed, pa.list_(pa.int32()))],
                                             names=["doc_id", "content", "removed"])
    return run


def common_blocks(later: list[int], chars: list[int], earlier: list[int], least_chars: int) -> list[int]:
    """Places of ``later`` in runs of aligned lines that have ``least_chars`` characters."""
    pairs = patience(later, earlier)
    out: list[int] = []
    run: list[int] = []
    for k, (i, j) in enumerate(pairs):
        run.append(i)
        if k + 1 == len(pairs) or pairs[k + 1] != (i + 1, j + 1):
            if sum(chars[x] for x in run) >= least_chars:
                out += run
            run = []
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of equal lines, in order in both lists.

    Equal lines at both ends of a range match; then lines that occur once in
    either range and lie in the longest rising order are anchors, and the ranges
    between them are matched alike.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {b[y]: y for y in range(j, j_end) if in_b[b[y]] == 1}
        anchors = _rising([(x, place[a[x]]) for x in range(i, i_end) if in_a[a[x]] == 1 and a[x] in place])
        if anchors:
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            pairs += anchors
            todo += [(x + 1, x_next, y + 1, y_next) for (x, y), (x_next, y_next) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs``, in order of their first place, whose second places rise."""
    tops: list[int] = []
    piles: list[tuple[int, int, int]] = []  # pair and the index of the one before it
    last: list[int] = []
    for x, y in pairs:
        k = bisect_left(tops, y)
        piles.append((x, y, last[k - 1] if k else -1))
        if k == len(tops):
            tops.append(y)
            last.append(len(piles) - 1)
        else:
            tops[k], last[k] = y, len(piles) - 1
    out = []
    at = last[-1] if last else -1
    while at >= 0:
        x, y, at = piles[at]
        out.append((x, y))
    return out[::-1]
