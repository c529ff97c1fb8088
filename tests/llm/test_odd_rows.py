"""Words made to share a polynomial hash, equal rows, repeated ids, few candidates, and columns named as operators name theirs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lingot.llm import ann, kd_sharding, mixing, substring_dedup, vector_dedup
from lingot.llm.wordarrays import Words

from . import fixtures as fx
from .test_pipeline import _inputs


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [16, 64, 1024, 4096])
def test_words_of_one_polynomial_hash_differ(n):
    w = Words([f"{thue_morse(n)} {thue_morse(n, 'b', 'a')} {thue_morse(n)}x {thue_morse(n)}"])
    for hashes in (w.hashes, w._word_hashes(1)):
        assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3
    apart = Words([thue_morse(n), "c", "é " + thue_morse(n)])
    assert apart.hashes[0] == w.hashes[0] == apart.hashes[3] and apart._word_hashes(1)[3] == w._word_hashes(1)[0]


def test_such_words_are_no_repeats(spark):
    common = " ".join(f"c{i}" for i in range(19))
    texts = [f"{common} {thue_morse(n)}" for n in (1024, 4096)] + [f"{common} {thue_morse(n, 'b', 'a')}" for n in (1024, 4096)]
    data = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, texts[0] + " more"])]
    got = {r["doc_id"]: (r["_n_removed"], r["_kept"]) for r in substring_dedup.without_repeats(fx.documents(spark, data)).collect()}
    assert got == {0: (0, texts[0]), 1: (0, texts[1]), 2: (0, texts[2]), 3: (0, texts[3]), 4: (20, "more")}


def test_equal_rows_are_cut_like_others(spark):
    data = [*fx.rows(), *[(77, "the same row", "en", "s1", 0)] * 5000, *[(78, None, None, None, 0)] * 500]
    got = kd_sharding.kd_shards(fx.documents(spark, data).repartition(3), n_shards=6).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == len(data) and set(size) == set(range(6))
    assert max(size.values()) - min(size.values()) < max(r["size"] for r in got) + 0.01 * sum(size.values())
    for shard in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_repeated_vec_ids_tie_their_classes(spark):
    one, two, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, one, 1), (5, one, 1), (3, two, 1), (5, two, 1), (9, far, 1), (9, one, 2), (9, far, 1), (4, None, 1), (None, far, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["component_id"], r["n_links"]) for r in vector_dedup.near_vectors(df).collect() if r["vec_id"] is not None)
    assert got == [(1, 1, 1), (3, 1, 1), (4, 4, 0), (5, 1, 1), (5, 1, 1), (9, 9, 0), (9, 9, 1), (9, 9, 1)]


@pytest.mark.parametrize("d", [8, 128])
def test_all_candidates_if_there_are_few(spark, d):
    x = np.random.default_rng(4).standard_normal(d)
    rows = [(0, (-x).tolist()), (0, (-x).tolist()), (50, (-2 * x).tolist()), (51, x.tolist()), (52, (4 * x).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 50), (0, 2, 51), (0, 3, 52), (50, 1, 0), (50, 2, 51), (50, 3, 52)]


CLASHING = ("_text_a", "_text_b", "_copy", "_kept", "_key", "_id", "_m", "_n_removed", "_repeated", "digest", "h", "size", "predicted", "rep")


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    folder = f"file://{tmp_path}"
    _inputs(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    value = F.coalesce("doc_id", F.lit(-1)) * 3
    docs = docs.select("doc_id", value.alias("_kept"), "text", *[value.alias(c) for c in CLASHING if c != "_kept"], "lang", "source", "n_chars")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns and docs.count() > 100, name
        assert docs.where(" or ".join(f"{c} <> doc_id * 3" for c in CLASHING)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_operators_carry_columns_of_any_name(spark):
    docs = fx.documents(spark, fx.rows(20)).withColumns({c: F.lit(5) for c in ("_kept", "_n_words", "_copy", "_m", "_digest")})
    found = substring_dedup.without_repeats(docs)
    assert {"_kept", "_n_words", "_n_removed", "_digest", "rep", "size"} <= set(found.columns) and len(found.columns) == len(docs.columns) + 3
    assert {r[0] for r in found.select("_digest").collect()} == {5} and found.count() == 21
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.select("_copy", "_m").collect()} == {(5, 5)}
