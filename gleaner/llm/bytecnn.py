"""Quality of a text by a small convolutional network over its bytes, in numpy.

Filters of ``WIDTH`` bytes slide over the whole text. Each chunk of two
neighbouring halves of ``HALF`` positions, so that chunks overlap by half, keeps
the maximum of each filter; a hidden layer turns it into a logit, and the mean
of the chunks' logits is the text's. A filter is a table of one weight for each
place and byte, so sliding it is a lookup.

Training is bounded by parameters: at most ``SAMPLE_ROWS`` rows of either label,
and of a long row ``TRAIN_CHUNKS`` chunks spread over it. Scores read the whole of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.hashing import uniform
from gleaner.llm.words import text_blocks
from gleaner.operators.skew import at_most

WIDTH = 5
FILTERS = 16
HIDDEN = 8
HALF = 256
SAMPLE_ROWS = 700
TRAIN_CHUNKS = 6
EPOCHS = 16
_PIECE = 16 * 1024


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        inner = np.maximum(np.maximum(pooled + self.bias, 0) @ self.hidden + self.hidden_bias, 0)
        return inner @ self.out + self.out_bias[0]


def learn(labels: DataFrame, docs: DataFrame, seed: int = 10) -> Network | float:
    """A network fitted to ``labels`` (``doc_id, label`` of 0 or 1) and the texts of ``docs`` (``doc_id, text``).

    Other labels, nulls and labels without a text's row teach nothing; a null
    text is empty. Labels are drawn by a hash of their id, as many of either
    kind, and only drawn texts are looked at. Where the drawn texts are all of
    one label there is nothing to tell apart: the result is that label, or 0.5
    without any, and every text scores it.
    """
    usable = labels.where("label in (0, 1) and doc_id is not null")
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, 1.25 * SAMPLE_ROWS / sizes[1]))).otherwise(F.lit(min(1.0, 1.25 * SAMPLE_ROWS / sizes[0])))
    picked = usable.withColumn("u", uniform(seed, "doc_id")).where(F.col("u") < rate)  # about 2.5 * SAMPLE_ROWS rows
    usable = docs.select("doc_id", "text").join(at_most(picked, round(2.5 * SAMPLE_ROWS)), "doc_id")
    size = 2 * HALF
    drawn = (usable.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("spare", F.greatest(F.lit(0), F.length("t") - size))
             .withColumn("n", F.least(F.lit(TRAIN_CHUNKS - 1), F.ceil(F.col("spare") / HALF)).cast("int"))
             .select("label", "u", F.expr(f"transform(sequence(0, n), i -> substring(t, 1 + cast(floor(i * spare / greatest(n, 1)) as int), {size}))").alias("chunks"))
             .collect())
    rows: dict[int, list] = {0: [], 1: []}
    for r in sorted(drawn, key=lambda r: (r["u"], r["chunks"])):
        if len(rows[r["label"]]) < SAMPLE_ROWS:
            rows[r["label"]].append([c.encode()[:size] for c in r["chunks"]])
    if not rows[0] or not rows[1]:
        return float(bool(rows[1])) if rows[0] or rows[1] else 0.5
    return _fitted(rows[0] + rows[1], np.array([0.0] * len(rows[0]) + [1.0] * len(rows[1])), seed)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """``doc_id, score`` of each row of ``docs`` (``doc_id, text``); other columns are ignored.

    Scores lie in 0 to 1, higher where label 1 is likelier. Null and empty texts
    are one chunk of padding. Repeated rows are scored each.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scorer(model), f"doc_id {kind}, score double")


def _scorer(model: Network | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                bounds = texts.bounds
                found = [model if isinstance(model, float) else _probability(model, texts.data[bounds[i]: bounds[i + 1]]) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first_row, len(texts)), pa.array(found, pa.float64())], names=["doc_id", "score"])
    return run


def _probability(model: Network, data: np.ndarray) -> float:
    halves = np.concatenate([_pooled(model.tables, data[at: at + _PIECE + WIDTH - 1], min(_PIECE, max(1, len(data) - at)))
                             for at in range(0, max(1, len(data)), _PIECE)])
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    return float(_sigmoid(model.logits(chunks).mean()))


def _convolved(tables: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Filter sums at the first ``n`` places, zero bytes following the data."""
    padded = np.zeros(n + WIDTH - 1, np.uint8)
    padded[: len(data)] = data
    total = tables[0].take(padded[:n], axis=0)
    for k in range(1, WIDTH):
        total += tables[k].take(padded[k: k + n], axis=0)
    return total


def _pooled(tables: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Maxima of each half chunk."""
    return np.maximum.reduceat(_convolved(tables, data, n), np.arange(0, n, HALF), axis=0)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fitted(rows: list[list[bytes]], labels: np.ndarray, seed: int) -> Network:
    """Adam on the logistic loss; the maximum passes its gradient to the place it came from."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                  rng.normal(0, 0.3, HIDDEN).astype(np.float32), np.zeros(1, np.float32))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        rate = 0.01 if epoch < EPOCHS // 2 else 0.003
        for at in range(0, len(order), 32):
            step += 1
            picked = order[at: at + 32]
            slopes = _slopes(net, [rows[i] for i in picked], labels[picked])
            for p, g, (m, v) in zip(net.parts(), slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def _slopes(net: Network, rows: list[list[bytes]], labels: np.ndarray) -> list[np.ndarray]:
    chunks = [c for r in rows for c in r]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = 1 / np.bincount(owner)[owner]
    peaks, windows = [], []
    for c in chunks:
        data = np.frombuffer(c, np.uint8)
        n = max(1, len(data))
        sums = _convolved(net.tables, data, n)
        place = sums.argmax(axis=0)
        padded = np.zeros(n + WIDTH - 1, np.uint8)
        padded[: len(data)] = data
        peaks.append(sums[place, np.arange(FILTERS)])
        windows.append(padded[place[:, None] + np.arange(WIDTH)])
    pooled, windows = np.array(peaks), np.array(windows)  # chunk x filter, chunk x filter x place
    active = np.maximum(pooled + net.bias, 0)
    inner = np.maximum(active @ net.hidden + net.hidden_bias, 0)
    z = np.bincount(owner, (inner @ net.out + net.out_bias[0]) * share)
    dz = ((_sigmoid(z) - labels) / len(rows))[owner] * share
    d_inner = np.outer(dz, net.out) * (inner > 0)
    d_active = (d_inner @ net.hidden.T) * (active > 0)
    cells = (np.arange(WIDTH)[None, None, :] * 256 + windows) * FILTERS + np.arange(FILTERS)[None, :, None]
    d_tables = np.bincount(cells.ravel(), np.repeat(d_active.ravel(), WIDTH), minlength=net.tables.size).reshape(net.tables.shape)
    parts = [d_tables, d_active.sum(0), active.T @ d_inner, d_inner.sum(0), inner.T @ dz, np.array([dz.sum()])]
    return [p.astype(np.float32) for p in parts]
