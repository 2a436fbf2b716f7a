import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bytecnn as B
from gleaner.llm import queries
from tests.llm.helpers import SCHEMA, SMALL, odd_rows


def test_held_out_accuracy(spark):
    labels = dict(pq.read_table(f"{SMALL}/labels.parquet").to_pandas()[["doc_id", "quality"]].itertuples(index=False))
    out = [r for r in queries.op10_quality_classifier(spark, SMALL).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in out) / len(out) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def network(seed=1):
    rng = np.random.default_rng(seed)
    return B.Network(*[rng.normal(0, 0.5, s).astype(np.float32) for s in
                       ((B.WIDTH, 256, B.FILTERS), B.FILTERS, (B.FILTERS, B.HIDDEN), B.HIDDEN, B.HIDDEN, 1)])


def plain_probability(net, data):
    padded = data + bytes(B.WIDTH - 1)
    n = max(1, len(data))
    padded = padded.ljust(n + B.WIDTH - 1, b"\0")
    sums = [sum(net.tables[k, padded[i + k]] for k in range(B.WIDTH)) for i in range(n)]
    halves = [np.max(sums[a: a + B.HALF], axis=0) for a in range(0, n, B.HALF)]
    chunks = [np.maximum(x, y) for x, y in zip(halves, halves[1:], strict=False)] or halves
    return 1 / (1 + np.exp(-np.mean([net.logits(c[None])[0] for c in chunks])))


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 700, B._PIECE - 1, B._PIECE, B._PIECE + 3])
def test_whole_text_is_scored(size):
    data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8)
    assert abs(B._probability(network(), data) - plain_probability(network(), data.tobytes())) < 1e-4


def test_slopes_are_those_of_the_loss():
    net, rows, labels = network(), [[b"abcdefg hij", b"xyz"], [b"qqqqqqqq"]], np.array([1.0, 0.0])

    def loss():
        total = 0.0
        for r, y in zip(rows, labels, strict=True):
            z = np.mean([net.logits(B._convolved(net.tables, np.frombuffer(c, np.uint8), len(c)).max(0)[None])[0] for c in r])
            total -= np.log(B._sigmoid(z if y else -z)) / len(rows)
        return total
    rng = np.random.default_rng(0)
    for part, slope in zip(net.parts(), B._slopes(net, rows, labels), strict=True):
        flat, flat_slope = part.reshape(-1), slope.reshape(-1)
        for i in [int(np.abs(flat_slope).argmax()), int(rng.integers(len(flat)))]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - flat_slope[i]) < 2e-2


def test_odd_rows_and_missing_labels(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    labels = spark.createDataFrame([(1, 1), (9, 0), (4, 0), (5, None), (None, 1), (77, 1)], "doc_id long, label int")
    out = B.score(rows, B.learn(labels, rows.select("doc_id", "text"))).collect()
    assert len(out) == rows.count() and all(0 <= r["score"] <= 1 for r in out)
    assert B.learn(labels.where("label = 1"), rows.select("doc_id", "text")) == 1.0
    assert B.learn(labels.limit(0), rows.select("doc_id", "text")) == 0.5
    # Labels whose documents have no row teach nothing, whichever label that leaves without any.
    texts = rows.withColumn("label", F.lit("a column of that name"))
    assert B.learn(labels.where("doc_id in (9, 77)"), texts) == 0.0
    assert B.learn(labels.where("doc_id = 77").unionByName(labels.sparkSession.createDataFrame([(78, 0)], "doc_id long, label int")), texts) == 0.5
    assert B.score(rows.limit(0), 0.5).count() == 0
