"""First claims against a walk row by row, and the validation of every form of exchange file."""

from __future__ import annotations

import json
import random

import pytest

from lingot.operators import claims, memory
from lingot.sources import exchange


def walk(rows):
    away, ids, keys = set(), {}, {}
    for f, p, i, k in sorted(rows):
        a, b = ids.setdefault(f, set()), keys.setdefault(f, set())
        if i in a or k in b:
            away.add((f, p))
        else:
            a.add(i)
            b.add(k)
    return away


@pytest.mark.parametrize("block", [100_000, 7, 3])
def test_claims_are_those_of_a_walk(spark, block):
    rng = random.Random(block)
    rows = [(f, p, rng.randint(0, 15), rng.randint(0, 15)) for f in range(4) for p in range(24)]
    rows += [(9, 2 * i + j, i, i + j) for i in range(12) for j in (0, 1)]  # a chain: each row shares its id with one neighbour and its key with the other
    rows += [(10, p, 1, p) for p in range(50)] + [(11, 0, 1, 1), (11, 1, 1, 2), (11, 2, 2, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id long, pos int, id long, key long, win string")
    got = {tuple(r) for r in claims.turned_away(df, "file_id", "pos", ["id", "key"], block).collect()}
    assert got == walk(rows) and (11, 1) in got and (11, 2) not in got
    assert claims.turned_away(df.limit(0), "file_id", "pos", ["id", "key"]).collect() == []


STRINGS = [("k1", "a.txt", "resource-text", 0, "New %d"), ("k2", "a.txt", "resource-text", 1, "Exit"), ("k3", "b.txt", "resource-text", 0, "Exit"), ("k4", "b.txt", "resource-text", 1, "Go")]


def tables(spark, old=()):
    return spark.createDataFrame(STRINGS, "key string, source string, kind string, idx int, value string"), spark.createDataFrame(list(old), "key string, translation string")


def item(i, key, **changes):
    import hashlib

    found = next((s for s in STRINGS if s[0] == key), ("", "", "", 0, ""))
    out = {"id": i, "key": key, "source": found[1], "kind": found[2], "index": found[3], "original": found[4], "original_sha256": hashlib.sha256(found[4].encode()).hexdigest(), "placeholders": ["%d"] if "%d" in found[4] else [], "translation": "vi " + found[4]}
    out |= changes
    return {k: v for k, v in out.items() if v is not ...}


def test_version_2_cascade(spark):
    items = [
        item("T1", "k1"), item("T1", "k2"), item("T2", "k2"), 5, "text", item("T3", "k3", translation=None), item("T4", "k4", translation=...), item("T5", "k9"), item("T6", "k4", original="Stop"), item("T7", "k5", original="x"),
        item(7, "k4", placeholders=["%s"]), item("7", "k8"),
    ]
    files = spark.createDataFrame([(1, "\ufeff " + json.dumps({"format": exchange.FORMAT_V2, "items": items})), (2, json.dumps({"format": exchange.FORMAT_V2})), (3, "null"), (4, None)], "file_id long, json string")
    rows = exchange.read_payloads(files)
    got = [r.outcome for r in memory.validate_rows(rows, *tables(spark)).orderBy("pos").collect()]
    # the third row is no duplicate: the row that shares its key was turned away; the last but one takes the place of "7" though it fails
    assert got == ["imported", "duplicate", "imported", "schema", "schema", "empty", "schema", "unknown", "original_mismatch", "unknown", "duplicate", "unknown"]


def test_old_forms(spark):
    v1 = {"items": [{"key": " k1 ", "original": "New %d", "translation": "m %d"}, {"key": "k1", "original": "New %d", "translation": "later"}, {"original": "Exit", "translation": "two have it"}, {"original": "Go", "translation": "g"}, {"key": "k2", "original": "Go", "translation": "g"}, 3, {"key": "k2", "original": "Exit", "translation": 9}, {"key": "k3", "original": "Exit", "translation": "%s"}, {"key": "k3", "original": "Exit", "translation": "e"}]}
    text = '{"Exit": "first", "Exit": "%d", "New %d": " ", "Go": 5, "none": "x"}'
    files = spark.createDataFrame([(1, json.dumps(v1)), (2, json.dumps(v1["items"])), (3, text)], "file_id long, json string")
    rows = exchange.read_payloads(files)
    strings, old = tables(spark, [("k4", "there")])
    loose = memory.validate_items(rows.where("form in ('v1', 'list')"), strings, old)
    want = ["imported", "skipped_existing", "unknown", "skipped_existing", "original_mismatch", "unknown", "empty", "placeholder", "imported"]
    assert [r.outcome for r in loose.orderBy("file_id", "pos").collect()] == want * 2
    again = memory.validate_items(rows.where("form = 'v1'"), strings, old, overwrite=True)
    assert [r.outcome for r in again.orderBy("pos").collect()] == ["imported", "placeholder", "unknown", "imported", "original_mismatch", "unknown", "empty", "placeholder", "imported"]
    told = memory.validate_dictionary(rows.where("form = 'dictionary'"), strings, old)
    assert sorted((r.original, r.target or "", r.outcome) for r in told.collect()) == [("Exit", "k2", "placeholder"), ("Exit", "k3", "placeholder"), ("Go", "", "unknown"), ("New %d", "", "empty"), ("none", "", "unknown")]
