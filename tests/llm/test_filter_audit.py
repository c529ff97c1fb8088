"""The filter audit, and its document-term matrix, against a document-by-document version."""

import re
from collections import Counter
from itertools import permutations

from lingot.llm.filter_audit import filter_audit, shard_counts, term_matrix

from .fixtures import documents, empty, rows, words


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int, part string")


def brute(data, said):
    good, toxic = {d for d, q, _, _ in said if d is not None and q == 1}, {d for d, _, t, _ in said if d is not None and t == 1}
    known = []
    for d, text, _, source, _ in data:
        t, w = text or "", words(text)
        smaller = any(e is not None and d is not None and e < d and (u or "") == t for e, u, *_ in data)
        known.append((source or "", d, "".join(f for f, on in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), smaller), strict=True) if on)))
    out, shapley = [], Counter()
    for part in {p for p, _, _ in known}:
        mine = [(d, f) for p, d, f in known if p == part]
        for o in permutations("ABCDE"):
            live = list(mine)
            for k, f in enumerate(o):
                gone = [x for x in live if f in x[1]]
                live = [x for x in live if f not in x[1]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(o), k + 1, len(live), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == f for _, x in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def odd_rows():
    extra = [(1000 + i, t, "en", s, 0) for i, (t, s) in enumerate([("A" * 300, ""), ("x#y", None), ("B b " * 150, "s1"), ("", "s1"), (None, "s2"), ("a b\x1cc", "s2"), ("ÄÖ" * 30, "s3"), ("$", "lone")])]
    return [*rows(), *extra, (None, "x#y", "en", "s1", 0), (None, None, None, None, 0), (1001, "x#y", "en", "s1", 0), *[(2000 + i, "same text $", "en", "s1", 0) for i in range(300)]]


def test_audit_is_brute_force(spark):
    data = odd_rows()
    said = [(3, 1, 0, "p"), (3, 0, 1, "p"), (12, 0, 1, "p"), (2001, 1, None, "p"), (None, 1, 1, "p"), (1001, 1, 1, "p"), (0, None, None, "p")]
    got = filter_audit(documents(spark, data).withColumnRenamed("key", "part").withColumnRenamed("h", "fails"), labels(spark, said))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute(data, said)


def test_empty_tables(spark):
    assert filter_audit(empty(spark), labels(spark, [])).collect() == []
    assert len(filter_audit(documents(spark, rows(20)), labels(spark, [])).select("part").distinct().collect()) == len({r[3] or "" for r in rows(20)})


def test_matrix_holds_every_count(spark):
    data = odd_rows()
    matrix, dictionary = term_matrix(documents(spark, data).repartition(3), "text", ["doc_id", "n_chars"], shard_bytes=700)
    said = {r["term"]: bytes(r["word"]).decode() for r in dictionary.collect()}
    shards = matrix.collect()
    assert sorted(said) == list(range(len(said))) and len(set(said.values())) == len(said) and len(shards) > 20
    assert set(said.values()) == {w for _, t, *_ in data for w in words(t)}
    found = Counter((s["doc_id"][i], tuple(sorted((said[t], c) for t, c in zip(s["indices"][a:b], s["data"][a:b], strict=True)))) for s in shards for i, (a, b) in enumerate(zip(s["indptr"], s["indptr"][1:], strict=False)))
    assert found == Counter((d, tuple(sorted(Counter(words(t)).items()))) for d, t, *_ in data)
    counts, _ = term_matrix(documents(spark, data), "text", ["doc_id", "n_chars"], then=shard_counts(["doc_id", "n_chars"]), schema="doc_id long, n_chars long, n_words long, n_distinct long")
    assert Counter(tuple(r) for r in counts.collect()) == Counter((d, n, len(words(t)), len(set(words(t)))) for d, t, _, _, n in data)


def test_shards_are_written_a_few_at_a_time(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from lingot.llm import filter_audit as audit
    from lingot.plans import scratch

    asked = {}
    monkeypatch.setattr(audit, "kept", lambda df, name, **said: asked.update({name: said}) or scratch.kept(df, name, **said))
    term_matrix(documents(spark, rows(20)), "text", ["doc_id"])
    assert asked["local-terms"] == {"large_rows": True}
    wide = spark.range(8).coalesce(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.xxhash64(i, F.col("id"))).alias("longs"))
    files = [f for name in scratch.kept(wide, "wide", large_rows=True).inputFiles() for f in glob.glob(name.removeprefix("file://"))]
    groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) == 8 and max(groups) <= 3
