"""Report texts, glyph gaps, ranks by ranges, plans, and queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lingot import queries
from lingot.functions import constants as K
from lingot.operators import byte_runs, compat, graph, intervals, memory, strings
from lingot.plans.ranks import ordered_place
from lingot.sources import tables as src

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CHECKED = ["j11_missing_glyphs", "o3_profile_intersections", "t5_bounded_lists", "f11_report_summaries", "a2_scan_diagnostics", "a6_build_readiness", "a17_all_findings", "p11_target_charsets", "s13_bundles", "x3_file_gates", "x1_scan", "s2_manifest_entries", "f9_font_descriptors", "w5_field_shifts", "e1_ascii_runs", "e3_utf16_runs", "e19_field_text", "w3_export_ids", "w7_slot_conflicts", "p3_entropy", "e4_legacy_runs", "x15_recommendation"]


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
    got = key([tuple(r) for r in df.collect()], df.columns)
    assert got and got == key(rel.fetchall(), rel.columns)


def test_rules_are_evaluated_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(strings.accepted(src.lines(spark, SF), ["source"], ["doc_id", "idx"])).count("regexp_replace") <= 8
    assert plan(queries.QUERIES["rank_sources"](spark, SF)).count("regexp_replace") <= 8


def test_places_of_a_group_in_many_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, "b").alias("g"), (F.col("id") * 7919 % 3001).alias("at"))
    got = ordered_place(rows, ["g"], ["at"], "place").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.at, r.place))
    assert len(got) == 3000 and all([p for _, p in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values()) and None in by


def test_slot_conflicts(spark):
    rows = [("s", 1, 2, "b"), ("s", 1, 1, "a"), ("s", 1, 3, "a"), (None, 1, 1, "x"), (None, 1, 2, "y")]
    got = memory.same_slot_conflicts(spark.createDataFrame(rows, "source string, slot int, idx int, translation string"), ["source", "slot"], ["idx"])
    assert sorted((r.source or "", r.idx, r.conflict) for r in got.collect()) == [("", 1, False), ("", 2, True), ("s", 1, False), ("s", 2, True), ("s", 3, False)]


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([("z", f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)], "archive_id string, src string, dst string").coalesce(1)
    got = graph.shortest_paths(edges, spark.createDataFrame([("z", "n000")], "archive_id string, root string"))
    assert got.agg(F.max("hops")).first()[0] == 70 and got.count() == 71


def test_font_descriptors(spark):
    texts = [("a", "char id=65\nchar id = 7842"), ("b", "id=66"), ("c", 'charset: "ABC DÉ"'), ("d", "chars=ab"), ("e", "U+41 U+1EA2"), ("f", "glyph list 65 7842 7 31"), ("g", "65 66"), ("h", "")]
    got = {}
    for r in compat.font_characters(spark.createDataFrame(texts, "source string, text string")).collect():
        got.setdefault((r.source, r.confidence), set()).add(r.ch)
    assert got == {("a", 95): {"A", "Ả"}, ("b", 95): {"B"}, ("c", 82): set("ABCDÉ"), ("e", 75): {"A", "Ả"}, ("f", 75): {"A", "Ả"}}


def test_required_characters_fall_back(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, None), (2, "  "), (3, None)], "grp int, translation string")
    got = {}
    for r in compat.required_characters(rows).collect():
        got.setdefault(r.grp, set()).add(r.ch)
    assert got == {1: {"a", "b"}, 2: set(K.VIETNAMESE), 3: set(K.VIETNAMESE)}


def test_utf16_letters_in_either_order(spark):
    for charset, big in (("utf-16-le", False), ("utf-16-be", True)):
        data = spark.createDataFrame([(1, bytearray("Hé\x01中文 ж\U0001f600ok".encode(charset)))], "doc_id long, content binary")
        assert [r.value for r in byte_runs.utf16_runs(data, "content", big_endian=big).collect()] == ["Hé", "中文 ж", "ok"]


def test_contents_without_fields_are_raw(spark):
    contents = spark.createDataFrame([(1, bytearray(b"plain run of text")), (2, bytearray(b"\x01\x02\xff")), (3, bytearray(b"\x00\x05hello"))], "doc_id long, content binary")
    got = {r.doc_id: (r.format_name, r.confidence) for r in intervals.format_summary(intervals.strongest_fields(contents), contents).collect()}
    assert got[1] == ("raw/unknown", 45) and got[2] == ("raw/unknown", 10) and got[3][0] != "raw/unknown"


def test_fixed_values_by_hand():
    assert K.UI_WORDS[0] == "ok" and K.UI_WORDS[-1] == "main menu" and K.API_COST["wma_sms"] == 25 and K.STARTUP_RANK["likely_startup_blocker"] == 3
    assert K.LOG_RULES[0] == ("OutOfMemoryError", "HIGH", "memory") and len(set(K.VIETNAMESE)) == 134
