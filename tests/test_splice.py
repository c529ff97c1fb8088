"""Patches of framed fields against a version that rewrites one field after the other, from the last to the first."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lingot.operators import intervals, rewrite, splice

FRAMES = {"u8": lambda b: bytes([len(b)]) + b, "u16be": lambda b: len(b).to_bytes(2, "big") + b, "u16le": lambda b: len(b).to_bytes(2, "little") + b, "null": lambda b: b + b"\0"}
MOST = {"u8": 255, "u16be": 65535, "u16le": 65535, "null": 10**9}
HEAD = {"u8": 1, "u16be": 2, "u16le": 2, "null": 0}
PATCH = "doc_id long, offset int, text string, kind string, translation string"


def made(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Menu", "größer", "中文字 go", "Start game", "Điểm cao", "quit"])
    contents = {}
    for d in range(12):
        out = b""
        for _ in range(rng.randint(1, 12)):
            text = " ".join(word() for _ in range(rng.randint(1, 8))).encode()
            out += bytes(rng.choice([0x81, 0xFF, 0xFE]) for _ in range(rng.randint(0, 3))) + FRAMES[rng.choice(list(FRAMES))](text)
        contents[d] = out
    return contents


def slow(contents, fields, patches):
    """The new contents and what becomes of each patch, content by content."""
    there, new, told = {(f.doc_id, f.start + HEAD[f.framing], f.text, f.framing): f for f in fields}, dict(contents), []
    for d in {p[0] for p in patches}:
        mine, ready, bad = [p for p in patches if p[0] == d], [], False
        for p in mine:
            parts = p[3].split(":")
            if parts[0] != "binary" or parts[-1] != "safe":
                told.append((*p, "SKIPPED"))
                continue
            f = there.get((d, p[1], p[2], parts[1]))
            bad |= f is None or not f.safe or len(p[4].encode()) > MOST[parts[1]] or any(r[1] is f for r in ready)
            ready.append((p, f))
        told += [(*p, "FAILED" if bad else "PATCHED") for p, _ in ready]
        for p, f in sorted(ready, key=lambda r: -r[0][1]) if not bad else []:
            new[d] = new[d][: f.start] + FRAMES[f.framing](p[4].encode()) + new[d][f.start + f.length :]
    return new, Counter(told)


@pytest.mark.parametrize("seed", [1, 2])
def test_transactions_are_those_of_one_after_the_other(spark, seed):
    contents = made(seed)
    df = spark.createDataFrame([(d, bytearray(c)) for d, c in contents.items()], "doc_id long, content binary")
    fields = intervals.strongest_fields(df, text=True)
    found = fields.collect()
    assert {f.framing for f in found} >= {"u8", "null"} and any(f.safe for f in found)
    rng, patches = random.Random(seed), []
    for f in found:
        if rng.random() < 0.7:
            row = [f.doc_id, f.start + HEAD[f.framing], f.text, f"binary:{f.framing}:safe", rng.choice(["x", "vi " + f.text, "Điểm" * 30, ""])]
            kind = rng.random()
            if kind < 0.1:
                row[3] = rng.choice([f"binary:{f.framing}:unsafe", "resource-text", "binary:odd:safe" if f.doc_id % 3 == 0 else "class-string"])
            elif kind < 0.2 and f.doc_id % 4 == 0:
                row[rng.choice([1, 2])] = rng.choice([row[1] + 1]) if rng.random() < 0.5 and isinstance(row[1], int) else row[1]
                row[2] = "gone"
            elif kind < 0.3 and f.doc_id % 4 == 1:
                row[4] = "y" * 70000
            patches.append(tuple(row))
            if kind > 0.98:
                patches.append((*row[:4], "again"))
    table = spark.createDataFrame(patches, PATCH)
    plan = splice.edit_plan(splice.preflight(table, fields))
    results = splice.spliced(df, plan)
    new, told = slow(contents, found, patches)
    assert {r.doc_id: bytes(r.content) for r in results.collect()} == new and all(r.ok for r in results.collect())
    assert Counter(tuple(r[c] for c in ("doc_id", "offset", "text", "kind", "translation", "status")) for r in splice.outcomes(plan, results).collect()) == told
    assert any(k[-1] == "PATCHED" for k in told) and any(k[-1] == "FAILED" for k in told)


def test_a_content_whose_frames_are_not_found_stays(spark):
    data = b"\x05hello\x00\x03abc"
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data))], "doc_id long, content binary")
    fields = spark.createDataFrame([(d, 0, 6, "u8", True, "hello") for d in (1, 2)], "doc_id long, start int, length int, framing string, safe boolean, text string")
    patches = spark.createDataFrame([(d, 1, "hello", "binary:u8:safe", "longer text") for d in (1, 2, 3)], PATCH)
    plan = splice.edit_plan(splice.preflight(patches, fields))
    wrong = plan.withColumn("shift", F.when(F.col("doc_id") == 2, F.col("shift") + 1).otherwise(F.col("shift")))
    results = splice.spliced(df, wrong)
    assert {r.doc_id: (bytes(r.content), r.ok) for r in results.collect()} == {1: (b"\x0blonger text\x00\x03abc", True), 2: (data, False)}
    assert {r.doc_id: r.status for r in splice.outcomes(wrong, results).collect()} == {1: "PATCHED", 2: "FAILED", 3: "FAILED"}


def test_round_trip_of_mixed_framings(spark):
    lines = spark.createDataFrame([(1, i, f"text number {i} é") for i in range(9)] + [(2, 0, "中文"), (3, 0, "")], "doc_id long, idx int, value string")
    contents, fields = rewrite.framed_mixed(lines)
    patches = fields.select("doc_id", (F.col("start") + splice.head(F.col("framing"))).alias("offset"), "text", F.concat_ws(":", F.lit("binary"), "framing", F.lit("safe")).alias("kind"), F.concat(F.col("text"), F.lit(" and more")).alias("translation"))
    plan = splice.edit_plan(splice.preflight(patches, fields))
    results = splice.spliced(contents, plan)
    assert {r.status for r in splice.outcomes(plan, results).collect()} == {"PATCHED"}
    want, _ = rewrite.framed_mixed(lines.where("value <> ''").withColumn("value", F.concat("value", F.lit(" and more"))))
    assert {r.doc_id: bytes(r.content) for r in results.collect()} == {r.doc_id: bytes(r.content) for r in want.collect()}


def test_regression_by_kind(spark):
    outputs = spark.createDataFrame([(1, bytearray("a neu b\nx".encode())), (2, bytearray(b"\x01\xffbin here")), (3, bytearray(b"class"))], "doc_id long, content binary")
    slots = spark.createDataFrame([(3, 0, "x cl y"), (3, 1, "whole")], "doc_id long, idx int, value string")
    rows = [
        (1, 0, "resource-text", "neu", "PASS"), (1, 1, "resource-text", "gone", "FAIL"), (1, 2, "deep-text", "neu", "SKIPPED"), (2, 0, "binary:u8:safe", "bin", "PASS"), (2, 1, "binary:u8:unsafe", "bin", "SKIPPED"), (2, 2, "binary:u8:safe", "no", "FAIL"),
        (2, 3, "resource-text", "bin", "FAIL"), (3, 0, "class-string", "cl", "FAIL"), (3, 7, "class-string", "whole", "PASS"), (4, 0, "binary:u8:unsafe", "x", "FAIL"), (4, 1, "resource-text", "x", "FAIL"), (1, 3, "class-string", "neu", "FAIL"),
    ]
    expected = spark.createDataFrame([r[:4] for r in rows], "doc_id long, idx int, kind string, translation string")
    got = {(r.doc_id, r.idx, r.kind, r.translation, r.status) for r in rewrite.validate_rebuild(expected, outputs, slots).collect()}
    assert got == set(rows)
