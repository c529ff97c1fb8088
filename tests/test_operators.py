"""Operators on small tables: exchange, rewriting, intervals, archives, graphs, verdicts; and queries against their SQL."""

from __future__ import annotations

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lingot import queries
from lingot.operators import byte_runs, compat, graph, intervals, logs, memory, rewrite
from lingot.sources import archives

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["rank_sources", "p1_language_score", "s7_exchange_files", "x3_validate_import", "a7_import_counts", "x5_rewrite_texts", "e15_framed_chain", "e16_outside_regions", "a11_activation_score", "x14_verdict", "x10_reachability", "w8_exception_events", "x17_diagnosis", "w11_history", "a4_progress", "r1_streamed_lines"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    key = lambda rows, cols: sorted(tuple(cell(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(rel.fetchall(), rel.columns)


def test_every_query_has_a_name_and_most_have_sql():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.ORACLE_SQL) > 80


def test_upsert(spark):
    store = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "key string, translation string")
    new = spark.createDataFrame([("a", " n "), ("b", "  "), ("d", "m")], "key string, translation string")
    assert sorted(map(tuple, memory.upsert(store, new).collect())) == [("a", "n"), ("c", "z"), ("d", "m")]
    assert sorted(map(tuple, memory.upsert(store, new, overwrite=False).collect())) == [("a", "x"), ("b", "y"), ("c", "z"), ("d", "m")]


def test_rewrite_keeps_endings_and_rolls_back(spark):
    docs = spark.createDataFrame([(1, "a= x \r\ny\rz"), (2, "q\nr")], "doc_id long, text string")
    patches = spark.createDataFrame([(1, 0, "x", "X1"), (1, 1, "gone", "n"), (1, 9, "x", "n"), (2, 0, "q", "中")], "doc_id long, idx int, original string, translation string")
    texts, items = rewrite.rewrite_texts(docs, patches, r"(?s)^[\x{0}-\x{ff}]*$")
    assert {r.doc_id: (r.text, r.rolled_back) for r in texts.collect()} == {1: ("a= X1 \r\ny\rz", False), 2: ("q\nr", True)}
    assert {(r.doc_id, r.idx): r.status for r in items.collect()} == {(1, 0): "PATCHED", (1, 1): "FAILED", (1, 9): "SKIPPED", (2, 0): "FAILED"}


def test_framed_fields_round_trip(spark):
    lines = spark.createDataFrame([(1, 0, "Größe"), (1, 1, "b"), (2, 0, "中文")], "doc_id long, idx int, value string")
    fields = rewrite.read_chain(rewrite.framed(lines))
    assert sorted((r.doc_id, r.nth, r.text) for r in fields.collect()) == [(1, 0, "Größe"), (1, 1, "b"), (2, 0, "中文")]


def test_strongest_equals_one_by_one(spark):
    import random

    rng = random.Random(5)
    rows = [(g, rng.randint(0, 300), rng.randint(3, 40), rng.random() < 0.5, rng.choice([70, 94, 96])) for g in range(3) for _ in range(80)]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    got = sorted((r.g, r.start, r.length) for r in intervals.strongest(spark.createDataFrame(rows, "g int, start int, length int, safe boolean, confidence int"), "g").collect())
    want = []
    for g in range(3):
        taken = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], -r[4], r[2], r[1])):
            if all(r[1] + r[2] <= s or s + n <= r[1] for _, s, n in taken):
                taken.append((g, r[1], r[2]))
        want += taken
    assert got == sorted(want)


def test_runs_in_bytes(spark):
    data = b"\x00New Game\x01\x02ab\xe4\xb8\xad\xe6\x96\x87\xffOK"
    df = spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary")
    assert [(r.start, r.value) for r in byte_runs.ascii_runs(df, "content").collect()] == [(1, "New Game")]
    assert [r.value for r in byte_runs.utf8_runs(df, "content").collect()] == ["ab中文"]
    wide = spark.createDataFrame([(1, bytearray("Hi there".encode("utf-16-be")))], "doc_id long, content binary")
    assert [r.value for r in byte_runs.utf16_runs(wide, "content", big_endian=True).collect()] == ["Hi there"]


def test_shortest_paths(spark):
    edges = spark.createDataFrame([("z", "a", "b"), ("z", "b", "c"), ("z", "a", "d"), ("z", "d", "c"), ("z", "c", "a"), ("y", "a", "q")], "archive_id string, src string, dst string")
    roots = spark.createDataFrame([("z", "a"), ("y", "a")], "archive_id string, root string")
    got = {(r.archive_id, r.node): r.path for r in graph.shortest_paths(edges, roots).collect()}
    assert got == {("z", "a"): ["a"], ("z", "b"): ["a", "b"], ("z", "d"): ["a", "d"], ("z", "c"): ["a", "b", "c"], ("y", "a"): ["a"], ("y", "q"): ["a", "q"]}


def test_reference_edges_match_prefixes_too(spark):
    rows = [("j", "game/Main.class", "calls game/MainMIDlet and x/y/Z"), ("j", "game/MainMIDlet.class", "self"), ("j", "y/Z.class", "uses game/Main")]
    got = graph.reference_edges(spark.createDataFrame(rows, "archive_id string, source string, content string"))
    assert {(r.src, r.dst) for r in got.collect()} == {("game/Main", "game/MainMIDlet"), ("game/Main", "y/Z"), ("y/Z", "game/Main")}


def test_archives_and_bundles(spark, tmp_path):
    def pack(name, files):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(data.getvalue())

    pack("good.jar", {"bundle_manifest.json": "{}", "runtime_diagnosis.json": '{"a": 1}', "run.log": "x", "d/": ""})
    pack("bad.jar", {"../up.txt": "x", "bundle_manifest.json": "{"})
    (tmp_path / "not.jar").write_bytes(b"no zip")
    members = archives.entries(spark, f"file://{tmp_path}")
    assert members.count() == 5
    got = {r.archive_id.rpartition("/")[2]: r for r in archives.inspect_bundles(members).collect()}
    assert got["good.jar"].valid and got["good.jar"].log_source == "run.log" and got["bad.jar"].rejected == "unsafe path" and not got["bad.jar"].valid
    keep = members.where(archives.should_scan(F.col("source"), F.col("size"), deep=True))
    assert keep.count() == 5


def _report(spark, rows):
    schema = "archive_id long, left struct<compatibility_score:int,detected_apis:array<string>,unsupported:array<string>,startup_classification:string,next_action:string>, right struct<compatibility_score:int,detected_apis:array<string>,unsupported:array<string>,startup_classification:string,next_action:string>"
    return spark.createDataFrame(rows, schema)


def test_verdicts(spark):
    low, high = "compatible_or_unknown", "likely_startup_blocker"
    rows = [
        (1, (50, ["nokia"], ["nokia"], high, "a"), (90, [], [], low, "b")),
        (2, (90, [], [], low, "a"), (50, ["nokia"], ["nokia"], high, "a")),
        (3, (50, ["m3g"], ["m3g"], low, "a"), (60, ["nokia"], ["nokia"], low, "a")),
        (4, (50, [], [], low, "a"), (50, [], [], low, "a")),
    ]
    got = {r.archive_id: r for r in compat.verdict(compat.compare_reports(_report(spark, rows))).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["IMPROVED", "REGRESSED", "MIXED", "UNCHANGED"]
    assert got[2].recommendation == "nokia" and got[4].reasons == ["No material compatibility change detected"]


def test_log_correlation(spark):
    lines = ["java.lang.NullPointerException: x", "  at game.Main.run(Main.java:1)", "Caused by: java.lang.ClassNotFoundException: javax/wireless/messaging/Conn", "  at game.Start.go(S.java)", "  at java.lang.Thread.run(T.java)", "fine"]
    log = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(lines)] + [(2, 1, "all well")], "log_id long, line_no int, line string")
    reports = spark.createDataFrame([(1, ["game/Start"], ["wma_sms"]), (2, [], [])], "log_id long, startup_path array<string>, detected_apis array<string>")
    got = {r.log_id: r for r in logs.diagnose(log, reports).collect()}
    assert got[1].probable_cause == "Runtime cannot resolve required class: javax.wireless.messaging.Conn"
    assert got[1].failing_path == ["game.Start", "game.Main", "wma_sms"] and got[1].root_exception == "ClassNotFoundException" and got[1].startup_overlap == ["game.Start"]
    assert got[2].probable_cause == "No high-confidence runtime failure detected" and got[2].exceptions == 0
