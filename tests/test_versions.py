"""The versioned store against a dictionary, and publishing source by source."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lingot.operators.publish import publish
from lingot.plans import versions

ROW = "key string, translation string, n int"


def test_versions_are_those_of_a_dictionary(spark, tmp_path):
    rng, path, held, history = random.Random(4), f"file://{tmp_path}/store", {}, []
    assert versions.load(spark, path) is None
    for number in range(6):
        new = {f"k{rng.randint(0, 30):02}": (f"t{number}", number) for _ in range(12)}
        gone = {f"k{rng.randint(0, 30):02}" for _ in range(4)} - set(new)
        changes = spark.createDataFrame([(k, *v) for k, v in new.items()], ROW)
        removed = spark.createDataFrame([(k,) for k in gone], "key string") if number % 2 else None
        wrote = versions.commit(spark, path, changes, number, gone=removed, autosave=number == 3, most_deltas=2)
        held = {k: v for k, v in {**held, **new}.items() if not (number % 2 and k in gone)}
        history.append(dict(held))
        assert wrote > 0 and versions.commit(spark, path, changes.limit(1), number) == 0  # once more: nothing
    for number, want in enumerate(history):
        got = versions.load(spark, path, version=number)
        assert {r.key: (r.translation, r.n) for r in got.rows.collect()} == want and got.version == number and got.dirty == (number == 3)
        assert got.folders <= 4
    near = versions.load(spark, path, low="k10", high="k15").rows.where("key between 'k10' and 'k15'")
    assert {r.key: (r.translation, r.n) for r in near.collect()} == {k: v for k, v in held.items() if "k10" <= k <= "k15"}
    assert versions.load(spark, path).version == 5 and versions.load(spark, path, version=9) is None
    with pytest.raises(ValueError, match="columns"):
        versions.commit(spark, path, changes.drop("n"), 7)


def test_a_version_without_a_manifest_is_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    versions.commit(spark, path, spark.createDataFrame([("a", "x", 1)], ROW), 1)
    spark.createDataFrame([("a", "lost", 2, False)], f"{ROW}, _gone boolean").write.parquet(f"{path}/data/unfinished")
    assert [tuple(r) for r in versions.load(spark, path).rows.collect()] == [("a", "x", 1)]
    versions.commit(spark, path, spark.createDataFrame([], ROW), 2, gone=spark.createDataFrame([("a",)], "key string"))
    assert versions.load(spark, path).rows.collect() == [] and versions.load(spark, path, version=1).rows.count() == 1


def test_another_format_is_an_error(spark, tmp_path):
    row = ("odd-store", 1, False, 0, "x", None, None, 0, "key string")
    spark.createDataFrame([row], versions.MANIFEST).write.json(f"file://{tmp_path}/manifests/v=1")
    with pytest.raises(ValueError, match="odd-store"):
        versions.load(spark, f"file://{tmp_path}")


def test_only_what_passes_is_published(spark, tmp_path):
    texts = {1: "New\nExit", 2: "New\nGo", 3: "x", 4: "y", 5: "Go\nStop", 6: "z"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [(1, 0, "New", "Mới"), (1, 1, "Exit", "Thoát"), (2, 0, "gone", "Mới"), (3, 0, "x", "X"), (4, 0, "y", "Y"), (5, 0, "Go", "Đi"), (6, 0, "z", "中")]
    patches = spark.createDataFrame(rows, "doc_id long, idx int, original string, translation string")
    expected = spark.createDataFrame([(d, i, "resource-text", t) for d, i, _, t in rows], "doc_id long, idx int, kind string, translation string")
    ready = spark.createDataFrame([(1, "READY"), (2, "READY"), (3, "BLOCKED"), (4, "WARNING"), (5, "WARNING"), (6, "READY")], "doc_id long, status string")
    path = f"file://{tmp_path}/published"
    run = lambda version: publish(docs, patches, expected, ready, path, version, allow_warnings=F.col("doc_id") == 5, encodable=r"(?s)^[\x{0}-\x{2fff}]*$")
    got = {r.doc_id: (r.status, r.patched, r.failed, r.checked, r.missing) for r in run(1).collect()}
    assert got == {1: ("PASS", 2, 0, 2, 0), 2: ("FAIL", 0, 1, 1, 1), 3: ("BLOCKED", 0, 0, 0, 0), 4: ("WARNING", 0, 0, 0, 0), 5: ("PASS", 1, 0, 1, 0), 6: ("FAIL", 0, 1, 1, 1)}
    out = {r.doc_id: bytes(r.content).decode() for r in versions.load(spark, path, key="doc_id").rows.collect()}
    assert out == {1: "Mới\nThoát", 5: "Đi\nStop"}
    run(1)
    assert versions.load(spark, path, key="doc_id").version == 1 and versions.load(spark, path, key="doc_id").folders == 1
