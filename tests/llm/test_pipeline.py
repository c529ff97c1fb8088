"""The pipeline's stages one after the other, each against the rows it was given."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline

from . import fixtures as fx


def _inputs(spark, folder):
    rng = random.Random(6)
    common = ["ther", "andan", "ofin", "lander", "mintho", "solar", "wavend", "toren", "bilit", "cardo", "nester", "quill"] + [f"w{i}x" for i in range(300)]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    passage = text(60)
    rows, labels = [], []
    for i in range(300):
        t = text(rng.randint(30, 150))
        if i % 10 == 0:
            t = "you idiot scum " + t
        if i % 10 == 1:
            t = text(20) + " " + passage + " " + text(30)
        if i % 10 == 2 and i > 10:
            t = rows[i - 10][1]
        if i % 10 == 3 and i > 10:
            t = rows[i - 10][1] + " tail"
        rows.append((i, t, "en", "s%d" % (i % 5), len(t)))
        labels.append((i, 1, int(i % 10 == 0)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([*rows, (400, None, None, None, None), (401, "", "en", "s1", 0)], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r[1] for r in rows}


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts = _inputs(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = lambda name: {r.doc_id for r in kept[name].select("doc_id").collect()}
    assert ids("toxicity") == {i for i in [*texts, 400, 401] if i % 10 or i in (400,)} | {401}
    assert all(not (i % 10 == 2 and i > 10) and not (i % 10 == 3 and i > 10) for i in ids("near_dedup") if i < 400)
    assert {i for i in ids("toxicity") if i % 10 in (0, 1, 4, 5, 6, 7, 8, 9)} <= ids("near_dedup")
    left = {r.doc_id: r for r in kept["substring_dedup"].collect()}
    assert set(left) == ids("near_dedup")
    assert left[1].text == texts[1] and len(fx.words(left[11].text)) == 50 and left[11].n_chars == len(left[11].text)
    assert all(left[i].text == texts[i] for i in left if i < 400 and i % 10 > 3)
    assert kept["mixing"].count() > 0 and ids("mixing") <= set(left)
    sequences = kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sequences.where("n > 4096").count() == 0
    assert kept["packing"].count() >= kept["mixing"].count()
    assert corpus_pipeline.run(spark, folder).count() == kept["packing"].count()


def test_toxic_rows_go_by_their_own_text(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts = _inputs(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = [(None, texts[10], "en", "s0", 1), (11, texts[20], "en", "s0", 1), (30, texts[31], "en", "s0", 1)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.toxicity(spark, docs.union(spark.createDataFrame(more, docs.schema)), folder).collect()]
    assert (None, texts[10]) not in got and (11, texts[20]) not in got and (11, texts[11]) in got and (30, texts[31]) in got and (30, texts[30]) not in got


def test_empty_tables_run_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
