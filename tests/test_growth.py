"""What keeps the cost of a query in step with its input."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lingot.functions import batches, codecs, fields, legacy
from lingot.operators import archive_scan, byte_runs, claims, intervals, logs, memory, splice, strings
from lingot.plans import scratch, versions
from lingot.sources import exchange
from lingot.streaming import log_streams


def test_framings_of_a_content_are_looked_at_together(monkeypatch):
    seen, old = [], legacy.best_codecs
    monkeypatch.setattr(legacy, "best_codecs", lambda a, start, end: seen.append(len(start)) or old(a, start, end))
    data = b"\x00\x05gr\xf6\xdfe" * 40
    assert len(fields.candidates(data)["start"]) and len(seen) == 1
    places = legacy.Places(np.frombuffer(b"a" * 5000 + "中".encode("gbk"), dtype=np.uint8))
    assert len(places.high) == 2
    good, sums = places.measured(np.array([904]), np.array([5000]), "gbk")
    assert good.all() and sums[0].tolist() == [4096, 4096, 0, 0, 0, 0, 0, 0, 4096]


def test_fields_are_looked_for_once(spark):
    docs = spark.createDataFrame([(1, bytearray(b"\x05hello")), (2, bytearray(b"\xff\xff"))], "doc_id long, content binary")
    plan = intervals.format_summary(intervals.strongest_fields(docs), docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_lines_do_not_go_to_the_driver(spark):
    log = spark.createDataFrame([(1, "no res/a.png here", "", "")], "log_id int, line string, class_name string, resource string")
    found = logs.patched_sources(log, spark.createDataFrame([("res/a.png",)], "path string").distinct())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "BuildRight" in plan and found.count() == 1


def test_decodings_are_told_apart_where_the_content_is(spark):
    docs = spark.createDataFrame([(1, bytearray(b"Start")), (2, None)], "id int, b binary")
    best = codecs.best_decoding(docs, "b", "id")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert [tuple(r) for r in best.orderBy("id").collect()] == [(1, "utf-8-sig", "Start"), (2, "utf-8-sig", "")]


def test_units_are_no_values_of_their_own(spark):
    text = "ab\x00" * 40_000 + "\U0001f600größe"
    docs = spark.createDataFrame([(1, bytearray(text.encode("utf-16-be"))), (2, None)], "doc_id int, b binary")
    runs = byte_runs.utf16_runs(docs, "b", big_endian=True)
    assert "transform" not in runs._jdf.queryExecution().executedPlan().toString()
    assert Counter(r.value for r in runs.collect()) == {"ab": 40_000, "größe": 1}


def test_dictionaries_with_very_long_names(spark):
    long = {"x" * 60_000: "vi x", "b": 3, "c": "vi c"}
    rows = exchange.read_payloads(spark.createDataFrame([(1, json.dumps(long)), (2, "{" + " " * 60_000)], "doc_id int, json string"))
    assert sorted((len(r.original), r.form, r.pos, r.translation) for r in rows.collect()) == [(1, "dictionary", 1, None), (1, "dictionary", 2, "vi c"), (60_000, "dictionary", 0, "vi x")]


def test_contents_are_spliced_without_python(spark):
    contents = spark.createDataFrame([(1, bytearray(b"..\x02ab--\x02cd!")), (2, bytearray(b"x"))], "doc_id long, content binary")
    plan = spark.createDataFrame([(1, "READY", 2, 3, 0, bytearray(b"\x03new")), (1, "READY", 7, 3, 1, bytearray(b"\x01c"))], "doc_id long, status string, start int, length int, shift long, frame binary")
    done = splice.spliced(contents, plan)
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, bytes(r.content), r.ok) for r in done.collect()) == [(1, b"..\x03new--\x01c!", True), (2, b"x", True)]


def test_batches_are_looked_at_in_slices():
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 100_000] * 50)], ["a", "b"])
    parts = [ids.to_pylist() for ids, _ in batches.slices(iter([b, b.slice(0, 0)]), "a", "b")]
    assert max(map(len, parts)) <= 11 and sum(parts, []) == list(range(50))


def test_claims_are_walked_without_a_table_for_each_group(spark):
    rows = spark.createDataFrame([(g, i, f"a{i // 2}", f"b{i}") for g in range(3) for i in range(6)], "g int, pos int, a string, b string")
    told = claims._walked(rows, "g", "pos", ["a", "b"], 100)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
    assert sorted((r.g, r.pos, r.win) for r in told.collect()) == [(g, i, i % 2 == 0) for g in range(3) for i in range(6)]


def test_batches_of_an_import_are_validated_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(versions, "commit", lambda spark, path, changes, version, gone: seen.append("Join" in changes._jdf.queryExecution().executedPlan().toString()))
    row = spark.createDataFrame([("f", 1, "k", " vi ")], "file_id string, pos int, key string, translation string")
    batch = {}
    stream = type("S", (), {"writeStream": type("W", (), {"foreachBatch": lambda self, f: batch.update(f=f) or self, "option": lambda self, *a: self})()})()
    log_streams.import_stream(stream, lambda df: df.withColumn("outcome", F.lit("imported")).join(row.select("key").distinct(), "key"), "store", "check")
    batch["f"](row, 0)
    assert seen == [False]


def test_units_of_short_runs_are_matched_together(monkeypatch):
    monkeypatch.setattr(codecs, "_UNIT", {})
    assert codecs.legacy_runs_of(b"\x00\x01" + "的一是ab".encode("big5") + b"\xff" + "不了".encode("big5"), "big5") == [(2, "的一是ab"), (11, "不了")]


def test_long_runs_are_cut_between_units():
    data = b"a" + "的".encode("gbk") * 5000
    assert [(s, len(t)) for s, t in codecs.legacy_runs_of(data, "gb18030")] == [(0, 2049), (4097, 2048), (8193, 904)]


def test_codecs_of_whole_texts_are_ranked_where_the_content_is(spark, monkeypatch):
    names = []
    monkeypatch.setattr(archive_scan, "kept", lambda df, name: names.append((name, df._jdf.queryExecution().executedPlan().toString())) or scratch.kept(df, name))
    entries = spark.createDataFrame([("a", 0, "x.odd", 5, bytearray(b"Start")), ("a", 1, "y.odd", 3, bytearray(3))], "archive_id string, pos int, source string, size long, content binary")
    assert [(r.source, r.value, r.encoding) for r in archive_scan.whole_texts(entries).collect()] == [("x.odd", "Start", "utf-8-sig")]
    plan = dict(reversed(names))["deep-codecs"]
    assert "MapInArrow" in plan and "Exchange" not in plan and "Window" not in plan


def test_fields_meet_their_patches_once(spark):
    patch = spark.createDataFrame([(1, 2, "ab", "binary:u16be:safe", "x"), (1, 2, "ab", "binary:u16be:safe", "y"), (2, 1, "c", "binary:u8:safe", "z"), (2, 9, "d", "resource-text", "z")], "doc_id long, offset int, text string, kind string, translation string")
    there = spark.createDataFrame([(1, 0, 4, "u16be", True, "ab"), (2, 0, 2, "u8", True, "c")], "doc_id long, start int, length int, framing string, safe boolean, text string")
    plan = splice.edit_plan(splice.preflight(patch, there))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted((r.doc_id, r.offset, r.met, r.status) for r in plan.where("met or met is null").collect()) == [(2, 1, True, "READY"), (2, 9, None, "SKIPPED")]
    assert [(r.met, r.status) for r in plan.where("doc_id = 1").collect()] == [(False, "FAILED")] * 2


def test_exchange_files_are_made_once(spark):
    rows = spark.createDataFrame([(7, i, "resource-text" if i != 2 else "other") for i in (3, 1, 2, 0)], "doc_id long, idx int, kind string")
    ids = strings.export_ids(rows, "doc_id", ["idx"], together=True)
    assert "parquet" not in ids._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.idx, r.id) for r in ids.collect()) == sorted((r.idx, r.id) for r in strings.export_ids(rows, "doc_id", ["idx"]).collect()) == [(0, "T00001"), (1, "T00002"), (3, "T00003")]
    files = spark.createDataFrame([("a", "b")], "a string, original string").select(F.to_json(F.struct("a", "original")).alias("json"))
    got = exchange.read_payloads(files)
    assert "to_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.form, r.original, r.translation) for r in got.collect()) == [("dictionary", "a", "a"), ("dictionary", "original", "b")]


def test_texts_of_an_import_are_not_moved_to_be_judged(spark, tmp_path, monkeypatch):
    written = []
    for module in (claims, memory):
        monkeypatch.setattr(module, "kept", lambda df, name: written.append((name, df.columns)) or scratch.kept(df, name))
    item = ("f", 1, "T1", "k" * 3000, "a.txt", "resource-text", 0, "x" * 3000, "", ["%d"], "vi")
    columns = "file_id string, pos int, id string, key string, source string, kind string, idx int, original string, original_sha256 string, placeholders array<string>, translation string"
    rows = spark.createDataFrame([item, (*item[:1], 2, *item[2:])], columns)
    rows.write.parquet(f"{tmp_path}/rows")
    strings = spark.createDataFrame([("k" * 3000, "a.txt", "resource-text", 0, "x" * 3000)], "key string, source string, kind string, idx int, value string")
    told = memory.validate_outcomes(spark.read.parquet(f"{tmp_path}/rows"), strings, strings.limit(0).selectExpr("key", "value as translation"))
    assert sorted((r.pos, r.outcome) for r in told.collect()) == [(1, "hash"), (2, "duplicate")]
    assert "exchange-rows" in dict(written) and not {"key", "original", "translation"} & {c for _, columns in written for c in columns}


def test_the_last_row_of_a_key_is_imported(spark, monkeypatch):
    changed = []
    monkeypatch.setattr(versions, "commit", lambda spark, path, changes, version, gone: changed.append((sorted(map(tuple, changes.collect())), sorted(map(tuple, gone.collect())))))
    rows = spark.createDataFrame([("f", 1, "k", "a"), ("g", 0, "k", " b "), ("f", 3, "m", "c"), ("f", 4, "m", " "), ("f", 5, "n", "d")], "file_id string, pos int, key string, translation string")
    batch = {}
    stream = type("S", (), {"writeStream": type("W", (), {"foreachBatch": lambda self, f: batch.update(f=f) or self, "option": lambda self, *a: self})()})()
    log_streams.import_stream(stream, lambda df: df.withColumn("outcome", F.lit("imported")), "store", "check")
    batch["f"](rows, 0)
    assert changed == [([("k", "b"), ("n", "d")], [("m", "")])]


def test_strings_of_archives_are_found_and_scored_once(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(archive_scan, "kept", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or scratch.kept(df, name))
    rows = [("a", 0, "x.odd", 40, b"\x00Start the game\x00Load the game now\x00"), ("a", 1, "y.txt", 20, b"one line of text")]
    entries = spark.createDataFrame(rows, "archive_id string, pos int, source string, size long, content binary")
    scan = archive_scan.scan_archives(entries)
    assert "MapInPandas" in plans["deep-found"] and "MapInPandas" not in plans["deep-strings"]
    assert "score" in scan.raw.columns
    told = strings.filter_counts(scan.raw, "archive_id")
    assert "rlike" not in told._jdf.queryExecution().optimizedPlan().toString().lower()
    unscored = strings.filter_counts(scan.raw.drop("score"), "archive_id")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, unscored.collect())) and told.count() == 1
