"""Accept and reject lists for the language score, and functions of text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lingot import queries
from lingot.functions import text as T
from lingot.functions.codecs import best_decoding, encodable
from lingot.functions.language import classify, threshold
from lingot.operators import strings
from lingot.sources import tables

ACCEPTED = [
    ("New Game", "class-string"), ("Continue", "class-string"), ("OK", "class-string"), ("HP", "class-string"), ("map", "class-string"),
    ("Game Over", "deep-binary-ascii"), ("Press start to continue", "deep-binary-ascii"), ("You cannot enter this stage", "deep-binary-ascii"), ("Level 3", "deep-binary-ascii"),
    ("开始游戏", "binary:u8:safe"), ("继续", "class-string"), ("确定要退出吗？", "class-string"), ("こんにちは世界", "binary:u16be:safe"), ("New record!", "resource-text"), ("Try again", "resource-text"),
]
REJECTED = [
    ("javax/microedition/lcdui/Canvas", "class-string"), ("com.siemens.mp.game", "class-string"), ("getPlayerName", "class-string"), ("(II)V", "class-string"), ("Ljava/lang/String;", "class-string"),
    ("http://example.com/x", "class-string"), ("a@b.com", "class-string"), ("0123456789abcdef", "class-string"), ("image/png", "class-string"), ("hero.png", "class-string"), ("%d", "class-string"),
    (".map", "class-string"), ("fadein", "class-string"), ("aplayer", "class-string"), ("scene[", "class-string"), ("RES_NAME", "class-string"), ("snake_case_name", "class-string"),
    ("item 1 2;", "binary:u8:safe"), ("xj{q|", "binary:u8:safe"), ("MIDlet-Name", "class-string"), ("/res/a.bin", "class-string"), ("", "class-string"), ("12345", "class-string"), ("x" * 900, "class-string"),
]


def test_accept_and_reject_lists(spark):
    rows = [(v, "a.class", k, True) for v, k in ACCEPTED] + [(v, "a.class", k, False) for v, k in REJECTED]
    got = classify(spark.createDataFrame(rows, "value string, source string, kind string, expect boolean"))
    wrong = got.withColumn("accepted", F.col("score") >= threshold(F.col("kind"))).where("accepted <> expect").select("value", "kind", "score", "reasons").collect()
    assert not wrong


def test_score_by_hand(spark):
    rows = [("New Game", "x", "class-string", 90 + 24 + 6 + 8 + 10 + 5), ("开始游戏", "x", "binary:u8:safe", 34 + 12 + 8 - 12 + 10 + 4)]
    got = classify(spark.createDataFrame(rows, "value string, source string, kind string, want int"))
    assert all(r.score == r.want for r in got.collect())


@pytest.mark.parametrize(("text", "want"), [("a %1$s {x} \\n <b> %%", ["%%", "%1$s", "<b>", "\\n", "{x}"]), ("plain", []), ("{0}{0}", ["{0}", "{0}"])])
def test_placeholders(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.placeholders("t").alias("p")).first()[0]
    assert got == sorted(want)


def test_mojibake_is_repaired_and_clean_text_stays(spark):
    texts = ["Größe über Maß", "été déjà là", "plain ascii", "中文文本", ""]
    rows = [(t, t.encode().decode("latin-1")) for t in texts]
    got = spark.createDataFrame(rows, "t string, damaged string").select("t", T.repair_mojibake("damaged").alias("r"), T.repair_mojibake("t").alias("same")).collect()
    assert all(r.same == r.t for r in got)
    assert [r.r for r in got if r.t in ("Größe über Maß", "中文文本", "")] == ["Größe über Maß", "中文文本", ""]


def test_mixed_islands_are_lossless(spark):
    data = bytes.fromhex("0503") + "中文".encode() + b"\xff\x00A" + "é".encode() + b"\xe4\xb8"
    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(T.mixed_islands(F.col("b")).alias("t"), T.structural_bytes(F.col("b")).alias("s")).first()
    assert got.t == "\x05\x03中文ÿ\x00Aé" + "ä¸" and got.s


def test_endpoints_within_endpoints(spark):
    got = spark.createDataFrame([("x sms://12 SMS://34\n y sms://",), ("none",)], "t string").select(T.endpoints("t").alias("e")).collect()
    assert got[0].e == sorted(["sms://12 SMS://34", "SMS://34", "sms://"]) and got[1].e == []


def test_best_decoding_by_quality(spark):
    rows = [(1, "中文文本很好".encode("gb18030")), (2, "Größe".encode()), (3, b"plain texts"), (4, b"")]
    got = {r.id: r for r in best_decoding(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id int, b binary"), "b", "id").collect()}
    # the quality measure rewards CJK letters, so short Latin texts with umlauts go to a Chinese codec
    assert got[1].text == "中文文本很好" and got[2].text == "Gr枚脽e" and got[3].text == "plain texts" and got[4].text == ""
    able = spark.createDataFrame([("中", "gbk"), ("ế", "gbk"), ("ế", "utf-8")], "t string, c string").select(encodable("t", "c").alias("ok")).collect()
    assert [r.ok for r in able] == [True, False, True]


def test_normal_forms_are_those_of_plain_replacement(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \t\n\r\x1c\x85\xa0\u2003\u3000 .'a\xe91\xbd\u4e2d'B\uac00\u30ac\u2167\u0301\U0001f600") for _ in range(rng.randrange(10))) for _ in range(3000)]
    space = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normal_space("t").alias("normal"), T.stripped("t").alias("stripped"), (F.size(T.word_tokens("t")) >= 2).alias("two"), T.several_words("t").alias("several"), T.script_count("t").alias("cjk"), T.letter_count("t").alias("letters")).collect()
    for r in got:
        assert r.normal == re.sub("^ | $", "", re.sub(f"{space}+", " ", r.t)) and r.stripped == re.sub(f"^{space}+|{space}+$", "", r.t)
        assert r.two == r.several and r.cjk == sum(c in "\u4e2d\uac00\u30ac" for c in r.t) and r.letters == sum(c in "a\xe9\u4e2dB\uac00\u30ac" for c in r.t)


def test_documents_are_dealt_before_their_lines_are_judged(spark):
    for name in ("rank_sources", "w1_first_accepted", "a2_scan_diagnostics"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan, name
    plan = strings.accepted(tables.lines(spark, "/root/testdata/sf0.001"), ["source"], ["doc_id", "idx"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(value") == 1  # the normal form is made once
