"""Operators on vectors against brute force, with null, zero, non-finite and equal vectors, and clashing columns."""

from __future__ import annotations

import numpy as np

from lingot.llm.ann import search
from lingot.llm.vector_dedup import near_vectors
from pyspark.sql import functions as F

from . import fixtures as fx

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, list int, block int, cell int, rep long"


def _rows(n=500, d=24, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:140] = x[100]  # equal vectors
    x[140:180] = x[140] + 0.02 * rng.standard_normal((40, d))  # near ones
    x[180:200] = x[20:40] * 3
    out = [(i, [float(v) for v in x[i]], i % 3 if i not in range(100, 180) else 1) for i in range(n)]
    out[5] = (5, None, 1)
    out[6] = (6, [0.0] * d, 1)
    out[7] = (7, [float("nan")] + [1.0] * (d - 1), 1)
    out[8] = (8, [None] + [1.0] * (d - 1), 1)
    out[9] = (9, [float("inf")] + [1.0] * (d - 1), 1)
    out[10] = (10, out[11][1], None)
    out[12] = (12, [], 1)
    out.append((None, out[11][1], 1))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def _good(rows):
    ok = [r for r in rows if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    ids = np.array([r[0] for r in ok])
    x = np.array([r[1] for r in ok], dtype=np.float32).astype(np.float64)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return ids, u, [r[2] for r in ok]


def test_search_recall_and_order(spark):
    rows = _rows()
    got = search(_frame(spark, rows), F.col("vec_id") % 10 == 0, k=5).collect()
    ids, u, _ = _good(rows)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [i for i in ids if i % 10 == 0]
    assert sorted(by) == sorted(queries)
    hits = 0
    for q in queries:
        s = u @ u[ids == q][0]
        s[ids == q] = -2
        want = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        found = sorted(by[q])
        assert [x[0] for x in found] == [1, 2, 3, 4, 5] and q not in [x[1] for x in found]
        assert all(abs(x[2] - s[ids == x[1]][0]) < 1e-12 for x in found)
        assert [(-x[2], x[1]) for x in found] == sorted((-x[2], x[1]) for x in found)
        hits += len({x[1] for x in found} & set(want.tolist()))
    assert hits / (5 * len(queries)) >= 0.9


def test_search_with_a_small_sample(spark):
    rows = _rows(900, seed=7)
    ids, u, _ = _good(rows)
    queries = [i for i in ids if i % 10 == 0]
    for sample_rows in (60, 20_000):
        by = {}
        for r in search(_frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, sample_rows=sample_rows).collect():
            by.setdefault(r.query_id, set()).add(r.vec_id)
        assert all(len(by[q]) == 5 for q in queries)
        want = lambda q: set(ids[np.lexsort((ids, -np.round(np.where(ids == q, -2, u @ u[ids == q][0]), 12)))[:5]].tolist())
        assert sum(len(by[q] & want(q)) for q in queries) / (5 * len(queries)) >= 0.9


def test_sample_alone_answers_nothing(spark, monkeypatch):
    from lingot.llm import ann

    # lists that hold no row: what the sample knows must not reach the answer
    monkeypatch.setattr(ann, "kept", lambda df, name: df.limit(0) if name == "ann-lists" else df)
    assert search(_frame(spark, _rows()), F.col("vec_id") % 10 == 0, k=5).count() == 0


def test_search_with_few_rows(spark):
    few = _frame(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 1.0], 1)])
    got = search(few, F.col("vec_id") == 0, k=5).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert search(_frame(spark, []), F.lit(True)).count() == 0


def test_near_vectors(spark):
    rows = _rows()
    got = {r.vec_id: r for r in near_vectors(_frame(spark, rows), 0.98).collect()}
    ids, u, labels = _good(rows)
    near = u @ u.T >= 0.98
    links = [(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in range(i) if labels[i] is not None and labels[i] == labels[j] and near[i, j]]
    assert len(links) > 1000
    want = fx.components([r[0] for r in rows if r[0] is not None], links)
    degree = dict.fromkeys(want, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for v, r in got.items():
        if v is None:
            assert r.n_links == 0 and r.kept
        else:
            assert (r.n_links, r.component_id, r.kept) == (degree[v], want[v], want[v] == v)
    assert len(got) == len(rows)
    assert near_vectors(_frame(spark, [])).count() == 0


def test_components_of_long_and_wide_graphs(spark):
    from lingot.llm.shared import components

    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6), (7, 6), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and all(got[i] == 0 for i in range(301)) and len(got) == 601
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
