"""Queries over lines take whole lines, however long."""

from __future__ import annotations

import math
import re
from collections import Counter

from lingot import queries
from lingot.queries_jobs import HAN, LETTERS


def test_whole_lines(spark, tmp_path):
    lines = ["ab" * 40 + "".join(chr(0x400 + i % 90) for i in range(500)) + "😀😀", "", "  a b.", ("the quick brown fox " * 700).strip(), "x" * 61 + "/" + "y" * 9]
    spark.createDataFrame([(1, "\n".join(lines), "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: queries.QUERIES[name](spark, f"file://{tmp_path}").collect()
    bits = lambda s: -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0
    got = {r.idx: r.bits for r in run("p3_entropy")}
    assert all(abs(got[i] - bits(s)) < 1e-6 for i, s in enumerate(lines)) and len(got) == len(lines)
    names = {r.idx: r.name for r in run("f13_safe_name")}
    assert names == {i: re.sub(r"[^\w.-]", "_", s).strip("._") or "unnamed" for i, s in enumerate(lines)}
    told = {}
    for r in sorted(run("e4_legacy_runs"), key=lambda r: (r.idx, r.start)):
        assert r.start == 2 + 2 * len(told.get(r.idx, ""))
        told[r.idx] = told.get(r.idx, "") + r.text
    han = lambda s: re.sub("[^a-z]", "", s.lower()).translate(str.maketrans(LETTERS, HAN))
    assert told == {i: han(s) for i, s in enumerate(lines) if len(han(s)) >= 2} and len(told[3]) > 4096
