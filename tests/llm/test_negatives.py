import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import negatives as N
from gleaner.llm import queries
from tests.llm.helpers import SMALL


def plain(rows, anchors):
    """``rows``: id to (label, whole numbers). All pairs, in Python's numbers."""
    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in sorted(anchors):
        label, x = rows[a]
        of = {b: score(x, y) for b, (_, y) in rows.items() if b != a}
        first = sorted((b for b in of if rows[b][0] == label), key=lambda b: (-of[b], b))[:5]
        for p in first:
            fit = [b for b in of if rows[b][0] != label and 30 * of[p] <= 100 * of[b] <= 90 * of[p]]
            out += [(a, p, k, b, of[p], of[b]) for k, b in enumerate(sorted(fit, key=lambda b: (-of[b], b))[:10], 1)]
    return sorted(out)


def test_whole_table(spark):
    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pandas()
    rows = {i: ((c + 1) % 10 if i % 7 == 0 else c, [math.floor(256 * float(v)) for v in x]) for i, x, c in table[["vec_id", "embedding", "label"]].itertuples(index=False)}
    out = queries.op12_hard_negatives(spark, SMALL)
    assert [c for c, _ in out.dtypes] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == plain(rows, [i for i in rows if i % 100 == 0])


@pytest.mark.parametrize("size,wide", [(10, 3), (2000, 64), (10 ** 6, 70), (10 ** 8, 200)])
def test_scores_are_exact(size, wide):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (7, wide)), rng.integers(-size, size + 1, (9, wide))
    a[0], b[0], b[1] = size, size, -size
    true = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
    primes = N.moduli(float(size) * size * wide)
    assert math.prod(primes) > 2 * size * size * wide
    assert N.scores(a.astype(float), b.astype(float), primes).tolist() == true


def test_too_large_scores_are_refused():
    assert len(N.moduli(2.0 ** 60)) <= len(N.PRIMES)
    with pytest.raises(ValueError):
        N.moduli(2.0 ** 61)
    with pytest.raises(ValueError):
        N.moduli(float("nan"))


def test_ties_labels_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = {}
    for i in range(400):
        x = [1.0, 0.5, -0.25] if i % 3 else (rng.normal(size=3)).round(1).tolist()  # two thirds are copies
        rows[i] = (0 if i % 2 else int(rng.integers(0, 3)), x)
    rows[401] = (0, [1.0])  # shorter: the rest counts as zeros
    rows[402] = (9, [0.0, 0.0, 0.0])
    nan, inf = float("nan"), float("inf")
    listed = [(i, x, c, 1, "n") for i, (c, x) in rows.items()] + [(5, rows[5][1], rows[5][0], 1, "n"), (6, [9.0, 9.0, 9.0], 9, 1, "n")]
    odd = [(500, None, 1, 1, ""), (501, [1.0, None, 1.0], 1, 1, ""), (502, [nan, 1.0, 1.0], 1, 1, ""), (503, [inf, 1.0, 1.0], 1, 1, ""), (600, [1.0, 1.0, 1.0], None, 1, ""), (None, [1.0, 1.0, 1.0], 1, 1, "")]
    df = spark.createDataFrame(listed + odd, "vec_id long, embedding array<double>, label int, rank int, _gl_x string")
    whole = {i: (c, [math.floor(256 * v) for v in x]) for i, (c, x) in rows.items()}
    want = plain(whole, [i for i in whole if i % 20 == 0])
    for slab in (8192, 64):
        monkeypatch.setattr(N, "_ROW_SLAB", slab)
        monkeypatch.setattr(N, "ROW_BLOCK", slab)
        monkeypatch.setattr(N, "ANCHOR_BLOCK", slab // 4)
        got = N.mined(N.usable(df), F.col("vec_id") % 20 == 0)
        assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert N.mined(N.usable(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0
    assert N.mined(N.usable(df), F.lit(False)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert N.mined(N.usable(alone), F.lit(True)).count() == 0
