"""Whitening of embeddings by a spectral divide and conquer on polar decompositions (QDWH).

Every entry c becomes the integer floor(64 c) + 1,000,000, so sums over the vectors are exact.  The
covariance is summed within tasks from vectors that are centred first, and added up by Spark, one number
for each pair of dimensions.  The polar factor of the covariance, shifted by a value inside its spectrum,
is the matrix sign, which gives the projector on the components above the shift; the two invariant
subspaces are split again until single components are left.  These, at most ``most``, are broadcast and
every vector is projected on them.

What the driver holds is a few matrices of d x d for vectors of d dimensions, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import complete

SCALE, ORIGIN = 64, 1_000_000
#: Entries from here on do not fit a long when scaled.
LARGEST = 2.0**55
#: Vectors that are projected at once.
ROWS = 4_096
#: A component whose variance is below this share of the largest has none that could be scaled to one.
FLAT = 1e-12
_EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by the dynamically weighted Halley iteration."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    low, one = _EPS, np.eye(n)
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both = np.linalg.qr(np.vstack((np.sqrt(r) * x, one)))[0]
            step = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        else:
            step = q / r * x + (p - q / r) * np.linalg.solve(one + r * x @ x, x)
        step = (step + step.T) / 2
        moved = np.linalg.norm(step - x)
        x, low = step, min(1.0, low * (p + q * square) / (1 + r * square))
        if moved < 10 * n * _EPS or (low >= 1 - 4 * _EPS and moved < 1e-5):
            break
    return x


def _halves(a: np.ndarray, shift: float, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Bases of the invariant subspaces above and below the shift, and how far they are from invariant; None if one is empty."""
    sign = polar(a - shift * np.eye(len(a)))
    above = (np.eye(len(a)) + sign) / 2
    k = round(float(np.trace(above)))
    if not 0 < k < len(a):
        return None
    first = np.linalg.qr(above @ seed[:, :k])[0]
    basis = np.linalg.qr(above @ first, mode="complete")[0]
    upper, lower = basis[:, :k], basis[:, k:]
    return upper, lower, float(np.linalg.norm(lower.T @ a @ upper))


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    d = len(v)
    v = (v + v.T) / 2
    size = max(float(np.linalg.norm(v)), np.finfo(np.float64).tiny)
    seed = np.random.default_rng(7).standard_normal((d, d))
    done, todo = [], [np.eye(d)]
    while todo:
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        m = len(a)
        mean = np.trace(a) / m
        if m == 1 or np.linalg.norm(a - mean * np.eye(m)) <= 4 * m * _EPS * size:
            done.append(basis)
            continue
        best = None
        # a shift that stands on an eigenvalue splits badly, another one is taken then
        for shift in (np.median(np.diag(a)), mean, *np.quantile(np.diag(a), (0.4, 0.6, 0.3, 0.7)), mean * (1 + 1e-3), mean * (1 - 1e-3)):
            found = _halves(a, float(shift), seed[:m, :m])
            if found and (best is None or found[2] < best[2]):
                best = found
            if best and best[2] <= 50 * m * _EPS * size:
                break
        if best is None:
            done.append(basis)
            continue
        todo += [basis @ best[0], basis @ best[1]]
    q = np.hstack(done)
    for _ in range(2):  # what rounding left between components goes by first-order corrections
        s = q.T @ v @ q
        e, r = np.diag(s) / np.einsum("ij,ij->j", q, q), np.eye(d) - q.T @ q
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= 1e-7 * size
        fix = np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
        np.fill_diagonal(fix, np.diag(r) / 2)
        q = q + q @ fix
    q = q @ (1.5 * np.eye(d) - q.T @ q / 2)
    e = np.einsum("ij,ij->j", q, v @ q) / np.einsum("ij,ij->j", q, q)
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


def _scaled(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The integers of a batch of complete vectors, a row for each."""
    c = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(SCALE * c).astype(np.int64) + ORIGIN


class _Centre:
    """n x - S of rows x in integers; a longer type where they might not fit."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.wide = n, 2 * n * largest >= 2**62
        self.sums = np.array(sums, dtype=object if self.wide else np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(object) if self.wide else x) * self.n - self.sums

    def deviations(self, y: np.ndarray) -> pa.Array:
        """Sums of squares of the rows of y, null where a long can't hold one."""
        if not self.wide and (not y.size or int(np.abs(y).max()) ** 2 * y.shape[1] < 2**63):
            return pa.array((y * y).sum(axis=1), pa.int64())
        sums = [sum(int(c) * int(c) for c in row) for row in y]
        return pa.array([s if s < 2**63 else None for s in sums], pa.int64())


def _parts(x: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(x), ROWS):
        yield x[k : k + ROWS]


def _cells(values: np.ndarray) -> pa.RecordBatch:
    flat = values.ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["cell", "value"])


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums, over tasks, of an array of this shape that every task gave one of."""
    out = np.zeros(int(np.prod(shape)))
    for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def _totals(rows: DataFrame, d: int) -> tuple[int, list[int], int]:
    """How many vectors there are, exact sums of their integers by dimension, and the largest of these in size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, high, low = 0, 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for b in batches:
            x = _scaled(b, d)
            if len(x):
                n, most = n + len(x), max(most, int(np.abs(x).max()))
                high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array([n] * d), pa.array([most] * d)], ["cell", "high", "low", "n", "most"])

    parts = rows.select("embedding").mapInArrow(add, "cell long, high long, low long, n long, most long")
    found = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("high", "low", "n")], F.max("most").alias("most")).orderBy("cell").collect()
    return found[0]["n"], [(r["high"] << 32) + r["low"] for r in found], found[0]["most"]


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    A vector that is null or holds null, NaN or infinite entries (or one of 2**55 and more in size) goes;
    a zero vector stays, and so do null and repeated vec_ids.  Only vectors of the commonest dimension (the smaller
    of two) are looked at; an empty vector has none.  whitened is null on a component without variance (all of them,
    if all vectors are equal), which explains 0 and takes no part in identity_error; identity_error is 0 if
    no component has any.  deviation is null where a long can't hold it.  Components of equal variance are
    any orthogonal ones.  No vectors give no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(complete(LARGEST))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    rows = rows.where(F.size("embedding") == d)
    n, sums, largest = _totals(rows, d)
    centre = _Centre(n, sums, largest)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            for x in _parts(_scaled(b, d)):
                y = (centre(x) / n).astype(np.float64)
                total += y.T @ y
        yield _cells(total)

    covariance = _summed(rows.select("embedding").mapInArrow(products, "cell long, value double"), (d, d)) / n
    e, q = components(covariance)
    k, trace = min(most, d), float(np.trace(covariance))
    alive = (e > FLAT * max(float(e[0]), 0.0))[:k]
    turn = q[:, :k] / np.sqrt(np.where(alive, e[:k], 1))
    explained = np.where(alive, e[:k] / (trace or 1.0), 0.0)
    shared = spark.sparkContext.broadcast((centre, turn))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        centre, turn = shared.value
        for b in batches:
            for x in _parts(_scaled(b, d)):
                w = (centre(x) / n).astype(np.float64) @ turn
                total += np.vstack((w.T @ w, w.sum(axis=0)))
        yield _cells(total)

    moments = _summed(rows.select("embedding").mapInArrow(spread, "cell long, value double"), (k + 1, k)) / n
    off = np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k))[np.ix_(alive, alive)]
    error = float(off.max()) if off.size else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, turn = shared.value
        for b in batches:
            ids = b.column("vec_id")
            for at, x in enumerate(_parts(_scaled(b, d))):
                y = centre(x)
                w = ((y / n).astype(np.float64) @ turn).ravel()
                each = pa.array(np.repeat(np.arange(len(x)), k))
                tiled = lambda values: np.tile(values, len(x))  # noqa: E731, B023
                columns = [ids.slice(at * ROWS, len(x)).take(each), pa.array(tiled(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(w), n)), centre.deviations(y).take(each)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(w, mask=~tiled(alive)), pa.array(tiled(explained)), pa.array(np.full(len(w), error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
