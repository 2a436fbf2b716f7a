import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleaner.llm import queries
from gleaner.llm import whitening as W
from tests.llm.helpers import SMALL


def plain(rows):
    """Ids, exact whole numbers and their covariance."""
    x = np.array([[math.floor(1024 * float(v)) + 100_000 for v in c] for c in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = (n * x - s).astype(float) / n
    return centred, deviation, centred.T @ centred / n


def test_whole_table(spark):
    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pandas().sort_values("vec_id")
    centred, deviation, cov = plain(table["embedding"])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u.T[::-1][:8]
    out = queries.op11_embedding_whitening(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 8 * len(table) and (out["n"] == len(table)).all()
    assert out["vec_id"].tolist() == np.repeat(table["vec_id"].to_numpy(), 8).tolist()
    assert out["deviation"].tolist() == np.repeat(deviation, 8).tolist()
    assert np.allclose(out["explained"].to_numpy().reshape(-1, 8), e / np.trace(cov), rtol=1e-12)
    got = out["whitened"].to_numpy().reshape(-1, 8)
    want = centred @ u.T / np.sqrt(e)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-9
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-10
    assert np.abs(got.T @ got / len(got) - got.mean(0)[:, None] * got.mean(0) - np.eye(8)).max() < 1e-10


def cases():
    rng = np.random.default_rng(0)
    yield from ((f"noise{n}", rng.normal(size=(n, n))) for n in (1, 2, 3, 8, 40))
    yield "graded", np.linalg.qr(rng.normal(size=(90, 30)) * np.logspace(0, -9, 30))[1]
    yield "diagonal", np.diag(rng.random(9))
    yield "equal values", np.eye(9)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield "two values, twenty times each", np.diag(np.r_[np.ones(20), np.full(20, 0.5)]) @ turn
    yield "nearly equal", np.diag(np.r_[np.ones(20) + 1e-6 * rng.random(20), np.full(20, 0.5)]) @ turn
    x = rng.normal(size=(60, 12))
    x[:, 3], x[:, 5] = x[:, 2], 0
    yield "copied and empty columns", np.linalg.qr(x)[1]
    yield "few rows", np.vstack([rng.normal(size=(3, 10)), np.zeros((7, 10))])
    yield "nothing", np.zeros((4, 4))
    for t in range(60):
        n = int(rng.integers(1, 20))
        yield f"whole numbers {t}", np.linalg.qr(np.round(rng.normal(size=(n + 5, n)) * 10.0 ** rng.integers(-1, 3, n)))[1]


@pytest.mark.parametrize("name,r", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_decomposition(name, r):
    values, vectors = W.covariance_components(r)
    true = np.linalg.svd(r, compute_uv=False) ** 2
    top = max(true[0], 1e-300)
    assert np.abs(values - true).max() <= 1e-13 * top
    assert np.abs(vectors @ vectors.T - np.eye(len(r))).max() < 1e-11
    assert np.abs(vectors @ (r.T @ r) - values[:, None] * vectors).max() <= 1e-12 * top


def test_singular_values_are_relatively_accurate():
    """A bidiagonal matrix fixes even its tiny values; dqds finds them to a few units of the last place."""
    q, e = np.logspace(0, -40, 21), np.logspace(-1, -41, 20)
    from fractions import Fraction
    found = W.dqds(q, e)
    product = Fraction(1)
    for v in q:
        product *= Fraction(v)
    got = Fraction(1)
    for v in found:
        got *= Fraction(float(v))
    assert abs(got / product - 1) < 1e-12


def test_rows_that_take_no_part_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 7), (2, None, 7), (3, [nan, 1.0], 7), (4, [1.0, None], 7), (5, [inf, 0.0], 7), (6, [0.5, -1.0], 7), (6, [0.5, -1.0], 7),
            (None, [3.0, 0.25], 7), (8, [], 7), (9, [1.0, 2.0, 3.0], 7), (10, [-1.0, 1e9], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long").repartition(3)
    points = W.usable(df)
    out = W.whitened(points, W.fit(points)).collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 2 and all(v is not None and math.isfinite(v) for v in r[1])]
    _, deviation, cov = plain([r[1] for r in kept])
    assert len(out) == 2 * len(kept) and {r["n"] for r in out} == {len(kept)}
    assert sorted(int(r["deviation"]) for r in out) == sorted(int(d) for d in deviation for _ in range(2))
    assert {r["vec_id"] for r in out} == {1, 6, 10, None} and max(r["identity_error"] for r in out) < 1e-6
    nothing = W.usable(df.limit(0))
    assert W.fit(nothing) is None and W.whitened(nothing, None).count() == 0
    one = W.usable(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"]) for r in W.whitened(one, W.fit(one)).collect()] == [(k, None, 0.0, 0) for k in (1, 2, 3)]


def test_factors_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    old, W.BLOCK_ROWS = W.BLOCK_ROWS, 7
    try:
        small = W.fit(W.usable(df.repartition(9)))
    finally:
        W.BLOCK_ROWS = old
    large = W.fit(W.usable(df.coalesce(1)))
    assert small.sums == large.sums and np.allclose(small.variances, large.variances, rtol=1e-12)
    assert np.allclose(np.abs((small.directions * large.directions).sum(1)), 1, atol=1e-9)
