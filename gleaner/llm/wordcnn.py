"""Toxicity of a text by a convolutional network over hashed words, in numpy.

A word is a run of letters and digits, A-Z taken as a-z. Its vector is the sum
of the vectors of its parts: the whole word and its beginnings of ``PREFIXES``
bytes, so that inflected forms share what their stem was taught. A part goes by
its hash: it has one of ``BUCKETS`` places, a place belongs to the commonest part
that falls into it, and a part that finds another one's hash there, like one
that fewer than ``LEAST_SHARE`` of the training rows hold, adds nothing. Filters
of one, two and three words slide over the whole text, and the maximum of each
goes through a hidden layer to one logit.

Thresholds are calibrated by language on training rows that the network wasn't
fitted to. The language is guessed from the words of the text itself, by word
frequencies of the training rows, never read from a column. A score is the
logistic of the logit's distance from its language's threshold, so 0.5 is the
threshold everywhere.

All rows with a label are learned from, each of them whole. Up to
``SAMPLE_ROWS`` rows of either label are fitted on the driver. Of more, all rows
say which parts are known and what these tell, a draw of that many is fitted on
the driver to begin with, and then all rows train in tasks: ``WORKER_ROWS`` rows
start from the same network, and the mean of what they arrive at is the next one
(``PASSES`` times). Thresholds are set on all rows kept back for that.

A text is kept as its distinct words' parts and the number of the word at each
place, and is spelled out only while its group of about ``GROUP_WORDS`` words is
at work. Scores read the whole of every text.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.hashing import uniform
from gleaner.llm.store import stored
from gleaner.llm.words import SEPARATORS, Texts, Words, spans_hashed, text_blocks, words_of
from gleaner.operators.skew import at_most, cut_lineage

BUCKETS = 1 << 18
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
HIDDEN = 8
SAMPLE_ROWS = 1500
WORKER_ROWS = 4096
"""About so many rows train one copy of the network in a task."""
PASSES = 2
BLOCK_ROWS = 4096
"""A part that enough of all rows hold is held by as great a share of some block of so many."""
BINS = 256
"""Logits are told apart to a fraction of 1 when thresholds are set on the rows of a whole table."""
GROUP_WORDS = 1 << 16
"""Words of texts that training and calibration look at together; a longer text is a group of its own."""
LEAST_SHARE = 0.003
"""Share of the training rows that a part must be in, two rows at least."""
PREFIXES = (4, 5, 6, 7)
EPOCHS = 14
BATCH = 32
CALIBRATION = 0.3
"""Share of the sample that thresholds are set on."""
LEAST_CALIBRATION = 6
"""Rows of either label that a language needs for a threshold of its own; else the common one holds."""
_SLAB = 16 * 1024
_PAD = max(WIDTHS)
_PARTS = 1 + len(PREFIXES)


@dataclass
class Network:
    """Row 0 of ``owners``, ``vectors`` and ``tongues`` is zero and stands for padding and for parts that were not learned."""

    places: np.ndarray  # bucket to row
    owners: np.ndarray  # hash of the part that each row belongs to
    vectors: np.ndarray  # rows x DIM
    tongues: np.ndarray  # rows x languages, log frequencies
    prior: np.ndarray
    filters: list[np.ndarray]  # of each width: width * DIM x FILTERS
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    thresholds: np.ndarray  # by language
    languages: list[str]

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        inner = np.maximum(np.maximum(pooled + self.bias, 0) @ self.hidden + self.hidden_bias, 0)
        return inner @ self.out + self.out_bias[0]


    def rows(self, parts: np.ndarray) -> np.ndarray:
        """The row of each part."""
        found = self.places[_bucket(parts)]
        return np.where(self.owners[found] == parts, found, 0)


@dataclass
class Drawn:
    """A whole text to learn from."""

    words: np.ndarray  # distinct words x parts
    turns: np.ndarray  # the word at each place
    lang: str | None
    u: float = 0.0  # its place in the draw


def parts_of(texts: Texts, words: Words) -> np.ndarray:
    """32-bit hashes of each word's parts, words x parts; 0 where a word is too short for a beginning."""
    out = np.zeros((len(words.hashes), _PARTS), np.uint32)
    out[:, 0] = words.hashes >> np.uint64(32)
    for k, size in enumerate(PREFIXES, 1):
        some = words.ends - words.starts >= size
        # Never equal to the whole word of the same letters, which is a part of its own.
        out[some, k] = (spans_hashed(texts.data, words.starts[some], words.starts[some] + size, lower=True) >> np.uint64(32)) ^ np.uint64(k)
    return out


def _bucket(parts: np.ndarray) -> np.ndarray:
    return (parts % np.uint32(BUCKETS)).astype(np.int64)


def learn(labels: DataFrame, docs: DataFrame, seed: int = 13) -> Network | float:
    """A network fitted to ``labels`` (``doc_id, label`` of 0 or 1) and the texts of ``docs`` (``doc_id, text``, and ``lang`` if there is one).

    Other labels, nulls and labels without a text's row teach nothing; a null
    text is empty. Columns of other names are ignored. Where the rows are all of
    one label there is nothing to tell apart: the result is that label, or 0.5
    without rows, and every text scores it.
    """
    usable = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    usable = usable.withColumn("u", uniform(seed, "doc_id"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"))
    known = stored(texts.join(at_most(usable, usable.count()), "doc_id").select("label", "u", "lang", "text"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    drawn = known.where(F.col("u") < _by_label({label: min(1.0, 1.25 * SAMPLE_ROWS / n) for label, n in sizes.items()}))  # about 2.5 * SAMPLE_ROWS rows
    drawn = cut_lineage(drawn.mapInArrow(_sampled, "label int, u double, lang string, words binary, turns binary"))
    rows: dict[int, list] = {0: [], 1: []}
    # A part of the texts at a time passes through the driver's JVM.
    for r in sorted(drawn.coalesce(32).toLocalIterator(), key=lambda r: (r["u"], r["lang"] or "", r["words"], r["turns"])):
        if len(rows[r["label"]]) < SAMPLE_ROWS:
            words = np.frombuffer(r["words"], np.uint32).reshape(-1, _PARTS)
            rows[r["label"]].append(Drawn(words, np.frombuffer(r["turns"], _turn_type(len(words))), r["lang"], r["u"]))
    return _fitted(rows, sizes, seed) if max(sizes.values()) <= SAMPLE_ROWS else _fitted_to_all(known, rows, sizes, seed)


def _by_label(values: dict[int, float]) -> Column:
    return F.when(F.col("label") == 1, F.lit(values[1])).otherwise(F.lit(values[0]))


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """``doc_id, score, lang_guess`` of each row of ``docs`` (``doc_id, text``); other columns are ignored.

    Scores lie in 0 to 1, higher where label 1 is likelier. Null and empty texts,
    and texts without a letter or digit, are one word of padding, and their
    language is null, as it is where no language was learned. Repeated rows are
    scored each.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scorer(model), f"doc_id {kind}, score double, lang_guess string")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of each text its distinct words, as hashes of their parts, and the number of the word at each place."""
    for batch in batches:
        for texts in text_blocks(batch.column(3)):
            found = words_of(texts, lower=True, breaks=SEPARATORS)
            part = batch.slice(texts.first_row, len(texts))
            parts = parts_of(texts, found)
            words, turns = [], []
            for a, b in zip(found.first[:-1], found.first[1:], strict=True):
                distinct, places = _distinct_words(parts[a:b])
                words.append(distinct.tobytes())
                turns.append(places.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(words, pa.binary()), pa.array(turns, pa.binary())], names=["label", "u", "lang", "words", "turns"])


def _distinct_words(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the number of the row at each place."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, first, places = np.unique(whole, return_index=True, return_inverse=True)
    return rows[first], places.ravel().astype(_turn_type(len(first)))


def _turn_type(n_words: int) -> type:
    return np.uint16 if n_words <= 1 << 16 else np.uint32


def _scorer(model: Network | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                if isinstance(model, float):
                    found, tongue = np.full(len(texts), model), [None] * len(texts)
                else:
                    words = words_of(texts, lower=True, breaks=SEPARATORS)
                    found, tongue = probabilities(model, model.rows(parts_of(texts, words)), words.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first_row, len(texts)), pa.array(found, pa.float64()), pa.array(tongue, pa.string())],
                    names=["doc_id", "score", "lang_guess"])
    return run


def probabilities(model: Network, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """Score and guessed language of each text, whose words begin at ``first``."""
    z = model.logits(_pooled(model, rows, first))
    n = np.diff(first)
    if not model.languages:
        return _sigmoid(z - model.thresholds[0]), [None] * len(n)
    best = _votes(model, rows, first).argmax(axis=1)
    names = [model.languages[b] if k else None for b, k in zip(best, n, strict=True)]
    return _sigmoid(z - np.where(n > 0, model.thresholds[best], model.thresholds[-1])), names


def _votes(model: Network, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log probability of each language by whole words, up to a constant."""
    out = np.tile(model.prior, (len(first) - 1, 1))
    for at in range(0, len(rows), _SLAB):
        sums = np.zeros((min(_SLAB, len(rows) - at) + 1, len(model.languages)))
        np.cumsum(model.tongues[rows[at: at + _SLAB, 0]], axis=0, out=sums[1:])
        edges = np.clip(first - at, 0, len(sums) - 1)
        out += sums[edges[1:]] - sums[edges[:-1]]
    return out


def _padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with ``_PAD`` zeros behind each text; where each text begins, and how many windows it has."""
    n = np.diff(first)
    out = np.zeros((len(rows) + _PAD * len(n), _PARTS), np.int64)
    out[np.arange(len(rows)) + _PAD * np.repeat(np.arange(len(n)), n)] = rows
    return out, first[:-1] + _PAD * np.arange(len(n)), np.maximum(n, 1)


def _looked_up(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the parts' vectors; most parts are unknown and cost nothing."""
    x = vectors[rows[:, 0]]
    for k in range(1, _PARTS):
        some = np.flatnonzero(rows[:, k])
        x[some] += vectors[rows[some, k]]
    return x


def _pooled(model: Network, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maxima of all filters over each text, a slab of words at a time."""
    padded, begins, n = _padded(rows, first)
    ends = begins + n
    out = np.full((len(n), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    for at in range(0, len(padded), _SLAB):
        stop = min(at + _SLAB, len(padded))
        x = _looked_up(model.vectors, padded[at: stop + _PAD])
        some = np.arange(np.searchsorted(ends, at, "right"), np.searchsorted(begins, stop))
        if not len(some):
            continue
        edges = np.stack([np.maximum(begins[some], at), np.minimum(ends[some], stop)], 1).ravel() - at
        sums = np.full((stop - at + 1, out.shape[1]), -np.inf, np.float32)  # one row more, so that every end is a place
        for k, (width, filters) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            own = sums[:-1, k * FILTERS: (k + 1) * FILTERS]
            own[:] = x[: len(own)] @ filters[:DIM]
            for j in range(1, width):
                part = x[j: j + len(own)]
                own[: len(part)] += part @ filters[j * DIM: (j + 1) * DIM]
        out[some] = np.maximum(out[some], np.maximum.reduceat(sums, edges, axis=0)[::2])
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# --- learning, on the driver, from few rows or a draw of many ------------------------


def _fitted(rows: dict[int, list], sizes: dict[int, int], seed: int) -> Network:
    """Fit on most rows of either label, set thresholds on the rest, both in the order of the draw."""
    fit, rest = [], []
    for label, some in rows.items():
        cut = max(1, round(len(some) * (1 - CALIBRATION)))
        fit += [(text, float(label)) for text in some[:cut]]
        rest += [(text, float(label)) for text in some[cut:]]
    rng = np.random.default_rng(seed)
    net = _started(fit, rng)
    _warmed_up(net, fit, rng)
    _calibrate(net, rest or fit, {y: sizes[int(y)] / max(1, sum(r[1] == y for r in rest or fit)) for y in (0.0, 1.0)})
    return net


def _warmed_up(net: Network, fit: list[tuple], rng: np.random.Generator) -> None:
    """``EPOCHS`` over rows on the driver."""
    coded = [(net.rows(text.words), text.turns) for text, _ in fit]
    labels = np.array([y for _, y in fit])
    adam = _Adam(net)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(coded))
        rate = 0.01 if epoch < EPOCHS // 2 else 0.003
        for at in range(0, len(order), BATCH):
            picked = order[at: at + BATCH]
            adam.step(_mean_slopes(net, [coded[i] for i in picked], labels[picked]), rate)


class _Adam:
    def __init__(self, net: Network):
        self.parts, self.n = [net.vectors, *net.dense()], 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parts]

    def step(self, slopes: list[tuple], rate: float) -> None:
        self.n += 1
        for p, (touched, g), (m, v) in zip(self.parts, slopes, self.moments, strict=True):
            # Of the word vectors only those that the batch touched move.
            m[touched] += 0.1 * (g - m[touched])
            v[touched] += 0.001 * (g * g - v[touched])
            p[touched] -= rate * (m[touched] / (1 - 0.9 ** self.n)) / (np.sqrt(v[touched] / (1 - 0.999 ** self.n)) + 1e-8)


def _started(fit: list[tuple], rng: np.random.Generator) -> Network:
    """The parts that enough of these rows hold, and first weights."""
    languages = sorted({text.lang for text, _ in fit if text.lang is not None})
    inside = [np.unique(text.words) for text, _ in fit]
    parts, where = np.unique(np.concatenate([np.zeros(1, np.uint32), *inside]), return_inverse=True)
    where = where[1:]
    of_one = np.repeat([y for _, y in fit], [len(u) for u in inside])
    ones, both = np.bincount(where, of_one, len(parts)), np.bincount(where, minlength=len(parts))
    known = np.flatnonzero((both >= max(2, LEAST_SHARE * len(fit))) & (parts > 0))
    counts = np.zeros((len(known), max(1, len(languages))))
    of = np.zeros(max(1, len(languages)))
    for text, _ in fit:
        if text.lang is not None:
            whole = text.words[:, 0]
            at = np.minimum(np.searchsorted(parts[known], whole), max(0, len(known) - 1))
            some = np.flatnonzero(parts[known][at] == whole) if len(known) else np.zeros(0, np.int64)
            np.add.at(counts[:, languages.index(text.lang)], at[some], np.bincount(text.turns, minlength=len(whole))[some])
            of[languages.index(text.lang)] += 1
    return _network(parts[known], ones[known], both[known], sum(y for _, y in fit), len(fit), counts, of, languages, rng)


def _network(parts: np.ndarray, ones: np.ndarray, both: np.ndarray, n_ones: float, n: int,
             counts: np.ndarray, of: np.ndarray, languages: list[str], rng: np.random.Generator) -> Network:
    """A network of these parts, ascending, with first weights.

    ``ones`` and ``both`` of ``n`` rows hold a part, and as a whole word it stands
    in ``counts`` places of each language, which ``of`` rows have. The first
    number of a part's vector starts at the log odds of its rows' labels, so that
    training starts from what single parts tell.
    """
    order = np.argsort(-both, kind="stable")
    _, firsts = np.unique(_bucket(parts[order]), return_index=True)  # the commonest part of each bucket
    known = order[np.sort(firsts)]
    places = np.zeros(BUCKETS, np.int32)
    places[_bucket(parts[known])] = np.arange(1, len(known) + 1)
    owners = np.concatenate([np.zeros(1, np.uint32), parts[known]])
    table = rng.normal(0, 0.05, (len(owners), DIM)).astype(np.float32)
    a, b = ones[known], both[known] - ones[known]
    table[1:, 0] = 0.5 * np.log((a + 0.5) / (n_ones + 1) / ((b + 0.5) / (n - n_ones + 1)))
    table[0] = 0
    counts = np.concatenate([np.zeros((1, counts.shape[1])), counts[known]]) + 0.1
    tongues = np.log(counts / counts[1:].sum(axis=0)) if len(counts) > 1 else np.zeros_like(counts)
    tongues -= tongues.mean(axis=1, keepdims=True)
    tongues[0] = 0
    return Network(
        places, owners, table, tongues.astype(np.float32), np.log((of + 1) / (of + 1).sum()),
        [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.3, (FILTERS * len(WIDTHS), HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
        rng.normal(0, 0.3, HIDDEN).astype(np.float32), np.zeros(1, np.float32), np.zeros(len(languages) + 1), languages)


# --- learning in tasks, from all rows -----------------------------------------------


def _fitted_to_all(known: DataFrame, rows: dict[int, list], sizes: dict[int, int], seed: int) -> Network:
    """As ``_fitted``, for more rows than the driver takes: ``rows`` of the draw begin, all of ``known(label, u, lang, text)`` follow."""
    cuts = {}
    for label, some in rows.items():
        cuts[label] = 1 - CALIBRATION if sizes[label] > SAMPLE_ROWS else some[max(1, round(len(some) * (1 - CALIBRATION))) - 1].u
    fit = known.where(F.col("u") <= _by_label(cuts))
    n_fit = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rng = np.random.default_rng(seed)
    net = _started_from_all(fit, n_fit, rng)
    begin = [(text, float(label)) for label, some in rows.items() for text in some if text.u <= cuts[label]]
    _warmed_up(net, begin, rng)
    # A row of either label weighs as much in all as those of the other.
    weights = {label: sum(n_fit.values()) / (2 * n) for label, n in n_fit.items()}
    workers = -(-sum(n_fit.values()) // WORKER_ROWS)
    dealt = fit.withColumn("worker", F.floor(uniform(seed + 1, F.col("u")) * workers).cast("int")).select("worker", "label", "u", "text")
    dealt = dealt.mapInArrow(_coder(net), "worker int, label int, u double, words binary, turns binary")
    dealt = cut_lineage(dealt.repartition(workers, "worker").sortWithinPartitions("worker", "u", "label", "turns", "words"))
    for turn in range(PASSES):
        trained = dealt.mapInArrow(_trainer(net, weights, 0.003 / (1 + 2 * turn), seed + turn), "worker int, n long, touched binary, moved binary")
        # What the tasks found is summed up in eight of them, so that the driver doesn't see each.
        summed = trained.withColumn("group", F.pmod("worker", F.lit(8))).repartition(8, "group").sortWithinPartitions("group", "worker")
        _moved(net, summed.mapInArrow(_summer(net), "n long, touched binary, moved binary").toArrow().to_pylist())
    _calibrate_to_all(net, known.where(~(F.col("u") <= _by_label(cuts))), fit, sizes)
    return net


def _started_from_all(fit: DataFrame, n_fit: dict[int, int], rng: np.random.Generator) -> Network:
    """``_started`` from a table: parts that some block of rows holds often enough are counted in all rows."""
    often = fit.select("text").mapInArrow(_often, "part long").distinct().toArrow().column("part").to_numpy()
    often = np.sort(often).astype(np.uint32)
    n = sum(n_fit.values())
    found = fit.select("label", "lang", "text").mapInArrow(_counter(often), "part long, lang string, ones long, both long, places long")
    found = found.groupBy("part", "lang").agg(*[F.sum(c).alias(c) for c in ("ones", "both", "places")])
    found = found.withColumn("total", F.sum("both").over(Window.partitionBy("part"))).where(F.col("total") >= max(2, LEAST_SHARE * n)).drop("total").toPandas()
    of_lang = {r["lang"]: r["n"] for r in fit.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(of_lang)
    parts, where = np.unique(found["part"].to_numpy().astype(np.uint32), return_inverse=True)
    ones, both = (np.bincount(where, found[c], len(parts)) for c in ("ones", "both"))
    counts = np.zeros((len(parts), max(1, len(languages))))
    spoken = found["lang"].notna().to_numpy()
    np.add.at(counts, (where[spoken], [languages.index(x) for x in found["lang"][spoken]]), found["places"].to_numpy()[spoken])
    of = np.array([of_lang[x] for x in languages] or [0.0])
    return _network(parts, ones, both, n_fit[1], n, counts, of, languages, rng)


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts that ``LEAST_SHARE`` of the rows of a block hold."""
    seen, n = [], 0

    def found() -> pa.RecordBatch:
        parts, rows = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(parts[(rows >= LEAST_SHARE * n) & (parts > 0)].astype(np.int64))], names=["part"])
    for batch in batches:
        for texts in text_blocks(batch.column(0)):
            words = words_of(texts, lower=True, breaks=SEPARATORS)
            seen.append(_parts_by_text(parts_of(texts, words), words.first)[1])
            n += len(texts)
            if n >= BLOCK_ROWS:
                yield found()
                seen, n = [], 0
    if n:
        yield found()


def _parts_by_text(parts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct parts: number of the text, part."""
    of = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    cells = np.unique((of[:, None] << np.uint64(32) | parts.astype(np.uint64)).ravel())
    return (cells >> np.uint64(32)).astype(np.int64), (cells & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _counter(often: np.ndarray):
    """By part of ``often`` and language: rows of label 1 and of both, and the places where it is the whole word."""
    def place(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(often, parts), max(0, len(often) - 1))
        some = np.flatnonzero(often[at] == parts) if len(often) else np.zeros(0, np.int64)
        return some, at[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            labels, langs = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), object)
            for texts in text_blocks(batch.column(2)):
                words = words_of(texts, lower=True, breaks=SEPARATORS)
                parts = parts_of(texts, words)
                here = slice(texts.first_row, texts.first_row + len(texts))
                y, names = labels[here], langs[here]
                of, held = _parts_by_text(parts, words.first)
                some, at = place(held)
                of = of[some]
                whole, whole_at = place(parts[:, 0])
                whole_of = np.repeat(np.arange(len(texts)), np.diff(words.first))[whole]
                for name in set(names):
                    own = sums.setdefault(name, np.zeros((3, len(often)), np.int64))
                    mine = names == name if name is not None else np.array([x is None for x in names])
                    own[0] += np.bincount(at[mine[of]], y[of[mine[of]]], len(often)).astype(np.int64)
                    own[1] += np.bincount(at[mine[of]], minlength=len(often))
                    own[2] += np.bincount(whole_at[mine[whole_of]], minlength=len(often))
        for name, (ones, both, places) in sums.items():
            some = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays(
                [pa.array(often[some].astype(np.int64)), pa.array([name] * len(some), pa.string()), *[pa.array(x[some]) for x in (ones, both, places)]],
                names=["part", "lang", "ones", "both", "places"])
    return run


def _coder(net: Network):
    """In place of each text the network's rows of its distinct words, and the number of the word at each place, compressed: most parts are unknown."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(3)):
                found = words_of(texts, lower=True, breaks=SEPARATORS)
                rows = net.rows(parts_of(texts, found)).astype(np.int32)
                pairs = [_distinct_words(rows[a:b]) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(texts.first_row, len(texts)).columns[:3], pa.array([zlib.compress(w.tobytes(), 1) for w, _ in pairs], pa.binary()),
                     pa.array([zlib.compress(t.tobytes(), 1) for _, t in pairs], pa.binary())], names=["worker", "label", "u", "words", "turns"])
    return run


def _trainer(net: Network, weights: dict[int, float], rate: float, seed: int):
    """Each worker's rows, which lie together, train a copy of the network: how many rows, which vectors they touched, how far all moved."""
    def trained(worker: int, rows: list[tuple]) -> pa.RecordBatch:
        own = copy.deepcopy(net)
        adam, order = _Adam(own), np.random.default_rng([seed, worker]).permutation(len(rows))
        touched = np.zeros(len(own.vectors), bool)
        for at in range(0, len(order), BATCH):
            picked = [rows[i] for i in order[at: at + BATCH]]
            labels = np.array([float(y) for y, *_ in picked])
            coded = []
            for _, words, turns in picked:
                words = np.frombuffer(zlib.decompress(words), np.int32).reshape(-1, _PARTS)
                coded.append((words, np.frombuffer(zlib.decompress(turns), _turn_type(len(words)))))
            found = _mean_slopes(own, coded, labels, np.array([weights[y] for y, *_ in picked]))
            touched[found[0][0]] = True
            adam.step(found, rate)
        moved = np.concatenate([(p - q).ravel() for p, q in zip([own.vectors, *own.dense()], [net.vectors, *net.dense()], strict=True)])
        return pa.RecordBatch.from_arrays(
            [pa.array([worker], pa.int32()), pa.array([len(rows)]), pa.array([np.packbits(touched).tobytes()], pa.binary()),
             pa.array([moved.astype(np.float32).tobytes()], pa.binary())], names=["worker", "n", "touched", "moved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, rows = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != worker:
                    if rows:
                        yield trained(worker, rows)
                    worker, rows = r[0], []
                rows.append((r[1], r[3], r[4]))
        if rows:
            yield trained(worker, rows)
    return run


def _summer(net: Network):
    """Sums over workers: rows, rows of the workers that touched a vector, and moves by rows."""
    size = len(net.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, touched, moved = 0, np.zeros(size), 0.0
        for batch in batches:
            for r in batch.to_pylist():
                n += r["n"]
                touched += r["n"] * np.unpackbits(np.frombuffer(r["touched"], np.uint8))[:size].astype(float)
                moved = moved + r["n"] * np.frombuffer(r["moved"], np.float32).astype(float)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([touched.tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], names=["n", "touched", "moved"])
    return run


def _moved(net: Network, sums: list[dict]) -> None:
    """The network goes to the mean of its copies; a vector to the mean of those that touched it."""
    n = sum(r["n"] for r in sums)
    touched = sum(np.frombuffer(r["touched"]) for r in sums)
    moved = sum(np.frombuffer(r["moved"]) for r in sums)
    at = net.vectors.size
    net.vectors += (moved[:at].reshape(net.vectors.shape) / np.maximum(touched, 1)[:, None]).astype(np.float32)
    for p in net.dense():
        p += (moved[at: at + p.size].reshape(p.shape) / n).astype(np.float32)
        at += p.size


def _calibrate_to_all(net: Network, rest: DataFrame, fit: DataFrame, sizes: dict[int, int]) -> None:
    """``_calibrate`` from a table: logits, to a ``BINS``-th, are counted by language and label."""
    def logits(rows: DataFrame) -> list:
        found = rows.select("label", "text").mapInArrow(_judged(net), "label int, guess int, bin long")
        return found.groupBy("label", "guess", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    found = logits(rest) or logits(fit)
    y, guess, z, n = (np.array([r[c] for r in found], float) for c in ("label", "guess", "bin", "n"))
    z = z / BINS
    w = n * np.array([sizes[int(label)] / max(1, n[y == label].sum()) for label in y])
    net.thresholds[:] = best_threshold(z, y, w)
    for k in range(len(net.languages)):
        own = guess == k
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= LEAST_CALIBRATION:
            net.thresholds[k] = best_threshold(z[own], y[own], w[own])


def _judged(net: Network):
    """Label, guessed language (-1 without words or languages) and logit as a whole number of ``BINS``-ths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                words = words_of(texts, lower=True, breaks=SEPARATORS)
                rows = net.rows(parts_of(texts, words))
                z = np.clip(net.logits(_pooled(net, rows, words.first)), -100, 100)
                guess = _votes(net, rows, words.first).argmax(axis=1) if net.languages else np.full(len(texts), -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first_row, len(texts)), pa.array(np.where(np.diff(words.first) > 0, guess, -1).astype(np.int32)),
                     pa.array(np.round(z * BINS).astype(np.int64))], names=["label", "guess", "bin"])
    return run


def _groups(lengths: list[int]) -> Iterator[slice]:
    """Texts in a row that have up to ``GROUP_WORDS`` words together, one text at least."""
    first, words = 0, 0
    for i, n in enumerate(lengths):
        if i > first and words + n > GROUP_WORDS:
            yield slice(first, i)
            first, words = i, 0
        words += n
    if lengths:
        yield slice(first, len(lengths))


def _mean_slopes(net: Network, coded: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray | None = None) -> list[tuple]:
    """``slopes`` of a batch, a group of its texts at a time."""
    weights = np.ones(len(coded)) if weights is None else weights
    found = []
    for some in _groups([len(turns) for _, turns in coded]):
        part = slopes(net, [rows[turns] for rows, turns in coded[some]], labels[some], weights[some])
        found.append([(at, g * ((some.stop - some.start) / len(coded))) for at, g in part])
    if len(found) == 1:
        return found[0]
    touched, where = np.unique(np.concatenate([part[0][0] for part in found]), return_inverse=True)
    total = np.zeros((len(touched), DIM), np.float32)
    np.add.at(total, where.ravel(), np.concatenate([part[0][1] for part in found]))
    return [(touched, total), *[(slice(None), sum(g for _, g in same)) for same in zip(*[part[1:] for part in found], strict=True)]]


def slopes(net: Network, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | float = 1.0) -> list[tuple]:
    """Slopes of the mean of each row's logistic loss times its weight, by part, as ``(indices, slope)``; a maximum passes its slope to the place it came from."""
    padded, begins, n = _padded(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    x = _looked_up(net.vectors, padded)
    pooled, places = [], []
    for width, filters in zip(WIDTHS, net.filters, strict=True):
        flat = np.lib.stride_tricks.sliding_window_view(x, width, axis=0).transpose(0, 2, 1).reshape(len(x) - width + 1, -1)
        sums = flat @ filters
        place = np.stack([s + sums[s: s + k].argmax(axis=0) for s, k in zip(begins, n, strict=True)])
        pooled.append(np.take_along_axis(sums, place, axis=0))
        places.append(place)
    pooled = np.concatenate(pooled, axis=1)
    active = np.maximum(pooled + net.bias, 0)
    inner = np.maximum(active @ net.hidden + net.hidden_bias, 0)
    dz = (_sigmoid(inner @ net.out + net.out_bias[0]) - labels) * weights / len(rows)
    d_inner = np.outer(dz, net.out) * (inner > 0)
    d_active = (d_inner @ net.hidden.T) * (active > 0)
    moved, by, d_filters = [], [], []
    for k, (width, filters, place) in enumerate(zip(WIDTHS, net.filters, places, strict=True)):
        d = d_active[:, k * FILTERS: (k + 1) * FILTERS]
        at = place[:, :, None] + np.arange(width)  # text x filter x word of the window
        d_filters.append(np.einsum("tfwd,tf->wdf", x[at], d).reshape(width * DIM, FILTERS))
        moved.append(at.ravel())
        by.append(np.einsum("wdf,tf->tfwd", filters.reshape(width, DIM, FILTERS), d).reshape(-1, DIM))
    moved, by = padded[np.concatenate(moved)], np.concatenate(by)
    touched, where = np.unique(moved, return_inverse=True)
    total = np.zeros((len(touched), DIM))
    np.add.at(total, where.ravel(), np.repeat(by, _PARTS, axis=0))
    dense = [*d_filters, d_active.sum(0), active.T @ d_inner, d_inner.sum(0), inner.T @ dz, np.array([dz.sum()])]
    return [(touched[touched > 0], total[touched > 0].astype(np.float32)), *[(slice(None), d.astype(np.float32)) for d in dense]]


def _calibrate(net: Network, rest: list[tuple], weight: dict[float, float]) -> None:
    """A threshold for each language, and last the common one: greatest F1 as the labels' own shares would have it."""
    n = np.array([len(text.turns) for text, _ in rest])
    z, guess = np.zeros(len(rest)), np.zeros(len(rest), np.int64)
    for some in _groups(n.tolist()):
        first = np.concatenate([[0], np.cumsum(n[some])])
        rows = np.concatenate([net.rows(text.words)[text.turns] for text, _ in rest[some]])
        z[some] = net.logits(_pooled(net, rows, first))
        if net.languages:
            guess[some] = _votes(net, rows, first).argmax(axis=1)
    y = np.array([label for _, label in rest])
    w = np.array([weight[label] for label in y])
    net.thresholds[:] = common = best_threshold(z, y, w)
    if net.languages:
        for k in range(len(net.languages)):
            own = (guess == k) & (n > 0)
            if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= LEAST_CALIBRATION:
                net.thresholds[k] = best_threshold(z[own], y[own], w[own])
    net.thresholds[-1] = common


def best_threshold(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut halfway between two logits with the greatest weighted F1; of several the one in the widest gap; 0 with one label alone."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.0
    order = np.argsort(z)
    z, y, w = z[order], y[order], w[order]
    above = np.cumsum((w * y)[::-1])[::-1]
    wrong = np.cumsum((w * (1 - y))[::-1])[::-1]
    f1 = np.round(2 * above / (above[0] + above + wrong), 9)
    gap = np.diff(z, prepend=z[0] - 1e-6)
    f1[gap <= 0] = -1  # equal logits are not told apart
    best = np.flatnonzero(f1 == f1.max())
    k = best[gap[best].argmax()]
    return float(z[k] - gap[k] / 2)
