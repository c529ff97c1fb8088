"""Labels of nodes against a search from each root, archive by archive."""

from __future__ import annotations

import random

import pytest

from lingot.operators import graph


def search(edges, root):
    """Paths of a breadth-first search whose neighbours go by name."""
    paths, queue = {root: [root]}, [root]
    for node in queue:
        for nxt in sorted({b for a, b in edges if a == node}):
            if nxt not in paths:
                paths[nxt] = [*paths[node], nxt]
                queue.append(nxt)
    return paths


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_root_and_its_path(spark, seed):
    rng = random.Random(seed)
    edges, roots, want = [], [], {}
    for a in range(5):
        names = [f"n{i:02}" for i in range(30)] + ["g/Payment", "g/Sms"]
        mine = [(rng.choice(names), rng.choice(names)) for _ in range(45 if a else 0)]
        mine += [(f"c{i:02}", f"c{i + 1:02}") for i in range(14)]  # a long chain
        start = [*rng.sample(names, 3), "c00"] if a != 3 else []
        edges += [(a, *e) for e in mine] + [(a, *mine[0])]
        roots += [(a, r, i) for i, r in enumerate(start)] + [(a, r, 9) for r in start[:1]]
        found = [search(mine, r) for r in start]
        for n in [*names, "c14", "absent"]:
            best = min((len(p[n]), i) for i, p in enumerate(found) if n in p) if any(n in p for p in found) else None
            want[a, n] = (start[best[1]], best[0] - 1, found[best[1]][n]) if best else (start[0] if start else "", None, [])
    e = spark.createDataFrame(edges, "archive_id long, src string, dst string")
    r = spark.createDataFrame(roots, "archive_id long, root string, place int")
    targets = spark.createDataFrame(list(want), "archive_id long, node string")
    got = graph.reachability(e, r, targets.union(targets)).collect()
    assert {(x.archive_id, x.node): (x.root, x.hops, x.path) for x in got} == want and len(got) == len(want)
    for a in range(5):
        mine = [x for x in got if x.archive_id == a]
        assert {x.activation_reachable for x in mine} == {any(x.reachable for x in mine)} and {x.payment_reachable for x in mine} == {any(x.reachable and "Pay" in x.node for x in mine)}
    assert graph.labelled_paths(graph.label(e.limit(0), r.limit(0)), targets).collect() == []
