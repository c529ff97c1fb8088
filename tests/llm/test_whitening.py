"""Whitening against numpy's eigenvectors over integers that are told row by row."""

import numpy as np
import pytest

from lingot.llm.whitening import components, polar, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, n long, value double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, 6, 7.0) for i, v in rows], SCHEMA)


def vectors(n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) / 4
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    rows[7] = (7, [0.0] * d)
    return [*rows, rows[3], (None, rows[4][1])]


def brute(rows, most):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    centred = np.array(y, dtype=np.float64) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    return good, [sum(c * c for c in v) for v in y], centred @ q[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


def test_components_are_those_of_numpy():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 40):
        a = rng.standard_normal((2 * d + 1, d))
        q = np.linalg.qr(a[:d])[0]
        for v in (a.T @ a, np.zeros((d, d)), q @ np.diag(np.repeat([4.0, 4, 1, 2], d)[:d]) @ q.T, q @ np.diag(10.0 ** -np.linspace(0, 9, d)) @ q.T, np.ones((d, d))):
            e, w = components(v)
            size = max(np.linalg.norm(v), 1e-300)
            assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * size
            assert np.abs(w.T @ w - np.eye(d)).max() < 1e-12 and np.linalg.norm(v @ w - w * e) <= 1e-13 * size


def test_polar_factor_is_the_sign():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((6, 6)))[0]
    e = np.array([3, 1e-9, -2, -1e-3, 5, -4.0])
    assert np.abs(polar(q * e @ q.T) - q * np.sign(e) @ q.T).max() < 1e-6


@pytest.mark.parametrize("most", [32, 4])
def test_rows_are_those_of_brute_force(spark, most):
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    rows = vectors()
    good, deviation, whitened, explained = brute(rows, most)
    got = whiten(frame(spark, [*rows, *odd, (905, [1.0, 2.0])]), most).collect()
    k = min(most, 12)
    assert len(got) == len(good) * k and {r["component"] for r in got} == set(range(1, k + 1))
    told = lambda r: (-1 if r["vec_id"] is None else r["vec_id"], r["component"], r["n"], r["deviation"])
    assert sorted(map(told, got)) == sorted((-1 if i is None else i, c + 1, len(good), deviation[p]) for p, (i, _) in enumerate(good) for c in range(k))
    value = {told(r)[:2]: r["whitened"] for r in got}
    for c in range(k):
        mine = np.array([value[(-1 if i is None else i, c + 1)] for i, _ in good])
        assert min(np.abs(mine - whitened[:, c]).max(), np.abs(mine + whitened[:, c]).max()) < 1e-9
    for r in got:
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-12 and 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_little_variance_and_large_entries(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    same = whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(same) == 8 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)
    flat = whiten(frame(spark, [(i, [float(i), 2.0]) for i in range(4)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True}
    large = whiten(frame(spark, [(i, [(-1.0) ** i * 2**50, float(i)]) for i in range(6)])).collect()
    assert len(large) == 12 and all(r["deviation"] is None for r in large)
    assert all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in large if r["component"] == 1)
