"""Second copies stand at the later positions of their own source's schedule."""

from __future__ import annotations

from lingot.llm.mixing import mix, mixed_documents

from . import fixtures as fx


def test_second_copies_stand_among_first_copies(spark):
    data = [(i, f"w{i} " * 10, "en", "s%d" % (0 if i < 20 else 1 + i % 2), 40) for i in range(200)]
    docs = fx.documents(spark, data)
    plan = {r.doc_id: r for r in mix(docs).collect()}
    order = [r.doc_id for r in mixed_documents(docs).collect()]
    assert len(order) == sum(int(r.taken / r["size"] + 0.5) for r in plan.values())
    seen, again, first = set(), [], []
    for at, i in enumerate(order):
        (again if i in seen else first).append(at)
        seen.add(i)
    assert again and min(again) < max(first)
    # of a source taken twice, all first copies come before its second ones, in the same queue
    small = [i for i in order if i < 20]
    assert sorted(small[:20]) == list(range(20)) and small[20:] == small[:20][: len(small) - 20]
