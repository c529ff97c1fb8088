"""The label model, the linear scorer and the k-d cuts against plain versions over single rows."""

from __future__ import annotations

import numpy as np
import pandas as pd

from lingot.llm import kd_sharding
from lingot.llm import weak_labels as wl

from . import fixtures as fx


def _votes(n=400, voters=5, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    v = np.zeros((n, voters), dtype=np.int8)
    for j in range(voters - 1):
        right = rng.random(n) < 0.6 + 0.08 * j
        v[:, j] = np.where(rng.random(n) < 0.5, 0, np.where(right == y, 1, -1))
    v[:, -1] = v[:, 0]  # a voter that repeats another
    return v, y


def _plain_em(v, prior, says, rounds):
    """Row by row, as the model is defined."""
    weight = np.ones(v.shape[1])

    def posterior(row):
        z = np.log(prior / (1 - prior))
        for j, x in enumerate(row):
            if x:
                z += weight[j] * np.log(says[j, int(x > 0), 1] / says[j, int(x > 0), 0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(rounds):
        p = np.array([posterior(r) for r in v])
        base = says.mean()
        new = np.empty_like(says)
        for j in range(v.shape[1]):
            for s, sign in enumerate((-1, 1)):
                for y, q in enumerate((1 - p, p)):
                    new[j, s, y] = (q[v[:, j] == sign].sum() + base) / (q.sum() + 1)
        before, prior, says = prior, float(np.clip(p.mean(), 0.005, 0.995)), np.clip(new, 1e-6, 1)
        if abs(prior - before) < 1e-4:
            break
    p = np.array([posterior(r) for r in v])
    linked = np.zeros((v.shape[1],) * 2)
    for q in (1 - p, p):
        mean = (q[:, None] * v).sum(axis=0) / q.sum()
        cov = np.array([[(q * v[:, a] * v[:, b]).sum() / q.sum() - mean[a] * mean[b] for b in range(v.shape[1])] for a in range(v.shape[1])])
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        linked += 0.5 * np.maximum(0, cov / np.outer(sd, sd) - 0.05)
    np.fill_diagonal(linked, 0)
    return prior, says, 1 / (1 + linked.sum(axis=1))


def test_label_model_is_em_over_rows(spark):
    v, _ = _votes()
    counted = pd.Series(wl.encode(v)).value_counts()
    patterns = spark.createDataFrame(list(zip(counted.index, map(int, counted), strict=True)), "pattern string, n long")
    first = wl.guess(np.full(v.shape[1], 0.8))
    model = wl.fit(patterns, v.shape[1], 0.3, first, rounds=8)
    prior, says, weight = _plain_em(v, 0.3, first.copy(), 8)
    assert abs(model.prior - prior) < 1e-9 and np.allclose(model.says, says) and np.allclose(model.weight, weight)
    assert model.weight[0] < model.weight[1] and model.weight[-1] < model.weight[1]


def test_linear_scorer_reaches_the_least_loss():
    rng = np.random.default_rng(4)
    size, l2 = 12, 1e-2
    rows = [np.sort(rng.choice(size, rng.integers(1, 5), replace=False)) for _ in range(300)]
    target = np.array([0.9 if 3 in r else 0.2 if 5 in r else 0.5 for r in rows])
    x = np.zeros((300, size + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1

    def loss(w):
        p = np.clip(1 / (1 + np.exp(-(x @ w))), 1e-12, 1 - 1e-12)
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean() + 0.5 * l2 * (w[:-1] ** 2).sum()

    w = np.zeros(size + 1)
    for _ in range(20_000):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - target) / 300
        g[:-1] += l2 * w[:-1]
        w -= 0.5 * g
    assert loss(wl.train_linear(rows, size, target, l2=l2)) < loss(w) + 1e-3


def test_cuts_separate_a_dimension_at_its_weighted_median(spark):
    data = [r for r in fx.rows(200) if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    got = {r.doc_id: r for r in kd_sharding.kd_shards(fx.documents(spark, data), n_shards=4).collect()}
    rows = [(got[r[0]].shard, got[r[0]]["size"], (np.floor(np.log2(got[r[0]]["size"]) * 4096), (r[2] or ""), (r[3] or ""))) for r in data]
    largest = max(x[1] for x in rows)
    for left, right in (({0, 1}, {2, 3}), ({0}, {1}), ({2}, {3})):
        a, b = [x for x in rows if x[0] in left], [x for x in rows if x[0] in right]
        # one dimension tells the sides apart, up to ties on its value, and they weigh the same up to one document
        assert any(max(x[2][d] for x in a) <= min(x[2][d] for x in b) for d in range(3))
        total = sum(x[1] for x in a) + sum(x[1] for x in b)
        assert abs(sum(x[1] for x in a) - total / 2) <= largest + 0.01 * total
