"""Whitening of embeddings through a bidiagonal singular value decomposition.

Tasks reduce the centred rows, a block at a time, to one triangular factor R
each (QR of R stacked on the next block), and the factors are stacked and
reduced again until one is left; no covariance is ever formed. R is as wide as a
vector, whatever the number of rows. It is made bidiagonal by Householder
reflections, its singular values come from the dqds algorithm, each to high
relative accuracy, and the vectors from twisted factorisations of the shifted
matrix, turned back by the reflections. Then every row is projected in its task.

Entries become whole numbers ``x = floor(SCALE * c) + SHIFT`` first, so sums,
means and the deviation of a row are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK_ROWS = 4096
FAN_IN = 32
"""Factors that one task reduces to one at a time; three levels take the factors of ``FAN_IN ** 2`` tasks to one per ``FAN_IN``."""
_EPS = np.finfo(float).eps
_EXACT = 1 << 62
_FINITE = float(_EXACT // SCALE)


@dataclass
class Whitener:
    """What was fitted: ``n`` rows with per-dimension sums ``sums``; unit ``directions`` as rows, by falling ``variances``."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    total: float  # trace of the covariance

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def has_variance(self) -> np.ndarray:
        """Which components vary at all, beyond rounding of the largest."""
        top = self.variances[0] if len(self.variances) else 0.0
        return self.variances > top * (len(self.sums) * _EPS) ** 2 * 16


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows of ``rows`` (``vec_id, embedding``) that have a whole, finite vector.

    Rows go whose vector is null, empty or holds null or non-finite entries or
    such that ``x`` is beyond a long, and rows whose vector is not of the
    commonest length (the shorter of several), as they are no points of the same
    space. A null id stays; repeated rows count each; other columns are ignored.
    """
    c = F.col("embedding")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < _FINITE))
    whole = rows.where(c.isNotNull() & (F.size(c) > 0)).where(finite)
    whole = whole.select("vec_id", c.cast("array<double>").alias("embedding"))
    sizes = whole.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return whole.limit(0).select("vec_id", F.col("embedding").cast("array<long>").alias("x"))
    # Spark may evaluate this before the filter, so it must bear any value.
    x = F.transform("embedding", lambda v: F.when(F.abs(v) < _FINITE, F.floor(v * SCALE) + SHIFT))
    return whole.where(F.size("embedding") == sizes[0]["d"]).select("vec_id", x.cast("array<long>").alias("x"))


def fit(points: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of ``points`` (``vec_id, x``, vectors of one length); None without rows.

    The driver holds sums and triangular factors, whose size follows from the
    length of a vector alone.
    """
    sums = points.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("k").collect()
    if not sums:
        return None
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    factors = points.select("x").mapInArrow(_factored(n, total), "at int, r array<double>")
    for keep in (FAN_IN * FAN_IN, FAN_IN, 1):
        factors = (factors.withColumn("at", F.pmod("at", F.lit(keep))).groupBy("at")
                   .applyInArrow(_merger(len(total)), "at int, r array<double>"))
    r = _square(factors.first()["r"], len(total)) / np.sqrt(n)
    variances, directions = covariance_components(r)
    trace = float((r * r).sum())
    k = min(components, len(total))
    return Whitener(n, total, variances[:k], directions[:k], trace)


def whitened(points: DataFrame, model: Whitener | None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each row and component.

    ``deviation`` is the exact sum of ``(n * x - S) ** 2`` over the dimensions,
    as ``decimal(38,0)``. ``identity_error`` is the largest entry of the measured
    covariance of ``whitened`` minus the identity, over the components that
    vary; a component without variance is ``whitened`` to null and explains 0.
    Vectors shorter than ``COMPONENTS`` give as many rows as they have dimensions.
    """
    kind = dict(points.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return points.sparkSession.createDataFrame([], schema)
    error = identity_error(points, model)
    return points.select("vec_id", "x").mapInArrow(_projector(model, error), schema)


def identity_error(points: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    varied = model.has_variance()
    k = int(varied.sum())
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _blocks(batch.column(0), len(model.sums)):
                w = _projected(model, x)[:, varied]
                m = w.mean(axis=0)
                spread += (w - m).T @ (w - m) + np.outer(m - mean, m - mean) * (n * len(w) / (n + len(w)))
                mean += (m - mean) * (len(w) / (n + len(w)))
                n += len(w)
        # Sums over tasks: n, n * mean, and the spread about 0.
        spread += n * np.outer(mean, mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k + 1), pa.int32()), pa.array(np.concatenate([[n], n * mean, spread.ravel()]), pa.float64())], names=["k", "v"])

    found = points.select("x").mapInArrow(moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    v = np.array([r["v"] for r in found])
    mean = v[1: k + 1] / v[0]
    return float(np.abs(v[k + 1:].reshape(k, k) / v[0] - np.outer(mean, mean) - np.eye(k)).max())


# --- inside tasks -------------------------------------------------------------------


def _blocks(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for at in range(0, len(flat), BLOCK_ROWS):
        yield flat[at: at + BLOCK_ROWS]


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: as 64-bit numbers where they suffice, else as Python's."""
    top = max(int(np.abs(x.min())), int(np.abs(x.max())), 1) if x.size else 1
    if n * top + max(map(abs, sums)) < _EXACT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _numerators(x, n, sums).astype(float) / n


def _factored(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for x in _blocks(batch.column(0), len(sums)):
                block = _centred(x, n, sums)
                r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
        if r is not None:
            yield _row(TaskContext.get().partitionId(), r)
    return run


def _row(at: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["at", "r"])


def _square(values, d: int) -> np.ndarray:
    """A factor of fewer rows than columns is filled up with zeros."""
    r = np.asarray(values, float).reshape(-1, d)
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])


def _merger(d: int):
    def run(key, part):
        r = None
        for own in part.column("r"):
            more = np.asarray(own.values.to_numpy(), float).reshape(-1, d)
            r = more if r is None else np.linalg.qr(np.vstack([r, more]), mode="r")
        return pa.Table.from_batches([_row(key[0].as_py(), r)])
    return run


def _projected(model: Whitener, x: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.where(model.has_variance(), model.variances, 1.0))
    return _centred(x, model.n, model.sums) @ model.directions.T / scale


def _projector(model: Whitener, error: float):
    k = len(model.variances)
    explained = model.variances / model.total if model.total else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1), len(model.sums)):
                m = len(x)
                w = _projected(model, x)
                w[:, ~model.has_variance()] = np.nan
                ids = batch.column(0).slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                    _deviations(x, model).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel(), pa.float64(), from_pandas=True),
                    pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += m
    return run


def _deviations(x: np.ndarray, model: Whitener) -> pa.Array:
    above = _numerators(x, model.n, model.sums)
    if above.dtype != object and int(np.abs(above).max(initial=0)) ** 2 * x.shape[1] >= _EXACT:
        above = above.astype(object)
    return pa.array((above * above).sum(axis=1).tolist(), pa.int64() if above.dtype != object else pa.decimal128(38, 0)).cast(pa.decimal128(38, 0))


# --- the small factor ---------------------------------------------------------------


def covariance_components(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``r.T @ r``, falling, and unit eigenvectors as rows; ``r`` is square."""
    scale = np.abs(r).max(initial=0.0)
    if scale == 0:
        return np.zeros(len(r)), np.eye(len(r))
    a, b, turn = bidiagonal(r / scale)
    values, vectors = [], []
    for at, stop in _unreduced(a, b):
        q, e = a[at:stop] ** 2, b[at: stop - 1] ** 2
        found = dqds(q, e)
        own = twisted_vectors(q, e, np.sign(a[at:stop]), np.sign(b[at: stop - 1]), found)
        for value, z in zip(found, own, strict=True):
            whole = np.zeros(len(a))
            whole[at:stop] = z
            values.append(value)
            vectors.append(whole)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * scale ** 2, np.array(vectors)[order] @ turn.T


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B in ``r = U B W.T``, and W, by Householder reflections from both sides."""
    work, n = r.astype(float).copy(), len(r)
    turn = np.eye(n)

    def reflector(v: np.ndarray) -> np.ndarray | None:
        tail = np.abs(v[1:]).max(initial=0.0)
        if tail == 0:
            return None
        u = v / max(tail, abs(v[0]))
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(work[k:, k])
        if u is not None:
            work[k:, k:] -= 2 * np.outer(u, u @ work[k:, k:])
        if k < n - 2:
            u = reflector(work[k, k + 1:])
            if u is not None:
                work[k:, k + 1:] -= 2 * np.outer(work[k:, k + 1:] @ u, u)
                turn[:, k + 1:] -= 2 * np.outer(turn[:, k + 1:] @ u, u)
    return np.diag(work).copy(), np.diag(work, 1).copy(), turn


def _unreduced(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges between superdiagonal entries that are nothing beside the matrix; ``a`` has its zeros lifted to that size."""
    top = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    nothing = top * _EPS / 4
    a[np.abs(a) < nothing * _EPS] = nothing * _EPS
    cuts = np.flatnonzero(np.abs(b) <= nothing) + 1
    return list(zip([0, *cuts], [*cuts, len(a)], strict=True))


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal with squared diagonal ``q`` and squared superdiagonal ``e``.

    Each turn is one differential quotient-difference sweep with a shift; a shift
    that would leave the positive numbers is taken back and halved, in the end to
    0, where the sweep has no subtraction. The last value splits off once its
    coupling is nothing beside it.
    """
    q, e, found, done, tries = list(map(float, q)), list(map(float, e)), [], 0.0, 0
    guess = 0.0
    while len(q) > 1:
        n = len(q)
        if q[0] < q[-1] and all(q[0] <= v for v in q):  # graded the wrong way: the mirror image has the same values
            q.reverse()
            e.reverse()
        if e[-1] <= (4 * _EPS) ** 2 * (done + q[-1]) or q[-1] == 0 and e[-1] == 0:
            found.append(done + q.pop())
            e.pop()
            guess, tries = 0.0, 0
            continue
        swept, shift = None, guess
        while swept is None:
            swept = _swept(q, e, shift)
            if swept is None:
                shift = shift / 4 if shift > _EPS * q[-1] else 0.0
        q, e, low = swept
        done += shift
        # The smaller value of the last two by two, a little less so that it stays below; nearer with each turn.
        t = (q[-1] + e[-1] + q[-2]) / 2
        gap = max(0.0, t * t - q[-1] * q[-2])
        near = q[-1] * q[-2] / (t + gap ** 0.5) if t > 0 else 0.0
        tries += 1
        guess = min(near, low) * (0.98 if tries < 30 else 0.5) if tries < 200 else 0.0
        if n > 2 and min(e) <= _EPS ** 2 * 1e-3 * (done + max(q)):
            k = e.index(min(e)) + 1
            if 0 < k < n - 1 or e[k - 1] == 0:
                found += [done + v for v in dqds(np.array(q[:k]), np.array(e[: k - 1]))]
                q, e = q[k:], e[k:]
                guess, tries = 0.0, 0
    found += [done + v for v in q]
    return np.sort(np.array(found))[::-1]


def _swept(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One sweep; None where the shift was too large. The last of the result is a bound for the next shift."""
    d = q[0] - shift
    low, new_q, new_e = d, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        s = d + e[k]
        ratio = q[k + 1] / s if s > 0 else 1.0
        new_q.append(s)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        low = min(low, d)
    if d < 0 or d != d:
        return None
    return [*new_q, d], new_e, max(0.0, low)


def twisted_vectors(q: np.ndarray, e: np.ndarray, sign_a: np.ndarray, sign_b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as rows, of the tridiagonal ``B.T @ B`` for its ``values``, falling.

    For each value the matrix is factored from the top and from the bottom, and
    the two meet where the least is left over; the vector follows by products
    alone. A Rayleigh step corrects the value until nothing changes. Where values
    are so near that their vectors come out alike, the whole group is found by
    inverse iteration of as many vectors at once.
    """
    # The factorisation is of |B|; signs of B carry over to the entries.
    turn = np.cumprod(np.concatenate([[1.0], np.where(sign_a[:-1] * sign_b < 0, -1.0, 1.0)]))
    diagonal, off = q + np.concatenate([[0.0], e]), sign_a[:-1] * sign_b * np.sqrt(q[:-1] * e)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    out = np.empty((len(values), len(q)))
    for k, value in enumerate(values):
        shift = value
        for _ in range(5):
            z, rest, norm = _twisted(q, e, shift)
            if abs(rest / norm) <= 2 * _EPS * abs(shift):
                break
            shift += rest / norm
        out[k] = z * turn / norm ** 0.5
    ends = np.flatnonzero(values[:-1] - values[1:] > 1e-3 * values[:-1]) + 1
    for at, stop in zip([0, *ends], [*ends, len(values)], strict=True):
        own = out[at:stop]
        loose = np.abs(own @ own.T - np.eye(stop - at)).max()
        rest = np.abs(own @ t - values[at:stop, None] * own).max()
        if not (loose <= 1e-11 and rest <= 1e-13 * values[0]):
            out[at:stop] = _group(t, values[at:stop])
    return out


def _group(t: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors of neighbouring values, by inverse iteration of them all and a turn within what they span."""
    size = np.abs(t).max()
    # A little off, so that none of the values grows much faster than the rest.
    shifted = t - (values.mean() + 500 * _EPS * size) * np.eye(len(t))
    z = np.random.default_rng(len(values)).normal(size=(len(t), len(values)))
    for _ in range(6):
        z = np.linalg.qr(np.linalg.solve(shifted, z))[0]
    _, within = np.linalg.eigh(z.T @ t @ z)
    return (z @ within[:, ::-1]).T


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, float, float]:
    """Vector with one entry 1, what is left over there, and its squared length."""
    n, tiny = len(q), np.finfo(float).tiny / _EPS
    root = np.sqrt(q[:-1] * e)  # off-diagonal of B.T @ B
    top, s = np.empty(n), np.empty(n)  # pivots from the top
    s[0] = -value
    for i in range(n):
        top[i] = s[i] + q[i]
        if top[i] == 0:
            top[i] = tiny
        if i + 1 < n:
            s[i + 1] = e[i] * (s[i] / top[i]) - value
    below, p = np.empty(n), np.empty(n)  # pivots from the bottom
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        below[i + 1] = e[i] + p[i + 1]
        if below[i + 1] == 0:
            below[i + 1] = tiny
        p[i] = p[i + 1] * (q[i] / below[i + 1]) - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -root[i] / top[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -root[i] / below[i + 1] * z[i]
    return z, float(gamma[k]), float(z @ z)
