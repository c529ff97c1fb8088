"""Queries over whole contents: no document is left out for its size, and fields equal those found one by one."""

from __future__ import annotations

import random
import re

import numpy as np

from lingot import queries
from lingot.functions import fields, legacy
from lingot.operators import graph, intervals, rewrite


def _slow(b):
    """Fields at every offset, read one at a time."""
    out = []
    for framing, head, most, good, poor in (("u16be", 2, 4096, 96, 72), ("u16le", 2, 4096, 94, 72), ("u8", 1, 240, 94, 70)):
        for at in range(len(b) - head):
            n = int.from_bytes(b[at : at + head], "little" if framing == "u16le" else "big")
            raw = b[at + head : at + head + n]
            if not 3 <= n <= most or at + head + n > len(b):
                continue
            out += _told(raw, at, head + n, framing, good, poor)
    at = 0
    for raw in b.split(b"\x00")[:-1]:
        out += _told(raw, at, len(raw) + 1, "null", 82, 68, 1) if len(raw) >= 3 else []
        at += len(raw) + 1
    return out


def _quality(text):
    n, cjk = len(text), re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\u31f0-\u31ff\uac00-\ud7af]")
    if not n:
        return -10.0
    share = lambda f: sum(map(f, text)) / n
    return share(lambda c: c.isprintable() or c in "\t\r\n") * 1.2 + share(str.isalpha) * 0.6 + share(lambda c: bool(cjk.match(c))) * 0.9 - share(lambda c: ord(c) < 32 and c not in "\t\r\n") * 1.7 - share(lambda c: c == "\ufffd") * 3 - share(lambda c: c in "ÃÂæçåéðï¤¦¥\x81\x9c") * 0.9 - share(lambda c: c == "\0") * 1.2


def _repaired(text):
    best, score = text, _quality(text)
    for codec in ("latin-1", "cp1252") if any(c in "ÃÂæçåéðï¤¦¥\x81\x9c" for c in text) else ():
        try:
            other = text.encode(codec).decode()
        except UnicodeError:
            continue
        if _quality(other) > score + 0.08:
            best, score = other, _quality(other)
    return best


def _islands(raw):
    out, i, told = "", 0, False
    while i < len(raw):
        width = 2 if 0xC2 <= raw[i] <= 0xDF else 3 if 0xE0 <= raw[i] <= 0xEF else 4 if 0xF0 <= raw[i] <= 0xF4 else 0
        try:
            char = raw[i : i + width].decode() if width and i + width <= len(raw) else ""
        except UnicodeDecodeError:
            char = ""
        out, i, told = out + (char or chr(raw[i])), i + (width if char else 1), told or bool(char)
    return out, told


def _read(raw, mixed):
    """The text of a field and as what it was read."""
    try:
        if any(c.isalpha() for c in raw.decode()):
            return raw.decode(), "utf-8"
    except UnicodeDecodeError:
        pass
    text, told = _islands(raw)
    if mixed and told and len(re.findall("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\u31f0-\u31ff\uac00-\ud7af]", text)) >= 2:
        return text, "mixed-utf8-binary"
    found = []
    for codec in ("gb18030", "gbk", "big5"):
        try:
            found.append((_repaired(raw.decode(codec)), codec))
        except UnicodeDecodeError:
            continue
    text, codec = max(found, key=lambda f: round(_quality(f[0]), 9)) if found else (raw.decode("latin-1"), "latin-1")
    return (text, codec) if any(c.isalpha() for c in text) else (None, None)


def _told(raw, at, length, framing, good, poor, least=2):
    if sum(32 <= b < 127 or b == 9 or b >= 128 for b in raw) / len(raw) < 0.85:
        return []
    text, codec = _read(raw, framing == "null")
    if text is None:
        return []
    safe = codec == "utf-8" and sum(c.isalpha() for c in text) >= least and not any(c < " " and c not in "\t\n\r" for c in text)
    return [(at, length, framing, good if safe else poor, safe, codec, text)]


HEADS = {"null": 0, "u8": 1, "u16be": 2, "u16le": 2}


def test_strength_is_told_by_the_text_and_not_its_frame(spark):
    data = b"\x20\x00" + b"a" * 31 + b" " + b"b" * 32
    frame = spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary")
    assert [(r.start, r.length, r.framing) for r in intervals.strongest_fields(frame).collect()] == [(0, 34, "u16le")]
    rows = spark.createDataFrame([(1, 0, 34, True, 94, 2, 32), (1, 33, 33, True, 94, 34, 32)], "g int, start int, length int, safe boolean, confidence int, text_start int, text_length int")
    assert [r.start for r in intervals.strongest(rows, "g").collect()] == [0]


def _chinese(rng):
    """Records in Chinese codecs, in islands of UTF-8 and wrongly decoded text, with odd bytes between."""
    words = ["游戏开始", "新游戏", "退出", "中文字", "é", "Ã©t", "go 12", "的一是不了人我在有他这中大来上国"]
    out = b""
    for i in range(120):
        text = "".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        codec = ("gb18030", "gbk", "big5", "utf-8")[i % 4]
        raw = text.encode(codec, "ignore") + ("\u4e02\U00020000".encode("gb18030") if i % 5 == 0 else b"")
        raw = b"\x01\x88" + raw if i % 7 == 0 else raw
        out += (bytes([min(len(raw), 255)]) if i % 3 == 0 else len(raw).to_bytes(2, "big") if i % 3 == 1 else b"") + raw + (b"\0" if i % 3 == 2 else b"")
    return out


def _contents():
    rng = random.Random(3)
    lines = lambda k: [" ".join(rng.choice(["Menu", "größer", "中文字", "go", "😀 ok", "x"]) for _ in range(rng.randint(1, 40))).encode() for _ in range(k)]
    framed = lambda k: b"".join(len(x).to_bytes(2, "big") + x for x in lines(k))
    return {1: framed(3), 2: framed(40), 3: bytes(rng.randrange(256) for _ in range(3000)) + framed(2), 4: b"\x03abc\xed\xa0\x80\x04ab\xf4\x90\x80\x80\x05hello\x04caf\xc3", 5: b"ab", 6: framed(2) + b"Start\x00" + bytes(9) + b"\xc3\x00Quit\x00caf\xc3\xa9\x00end", 7: _chinese(rng)}


def test_fields_at_every_offset(spark):
    docs = _contents()
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc_id long, content binary")
    got = sorted((r.doc_id, r.start, r.length, r.framing, r.confidence, r.safe, r.encoding, r.text) for r in intervals.framed_candidates(frame).collect())
    assert got == sorted((k, *c) for k, v in docs.items() for c in _slow(v)) and len(got) > 1000
    want = []
    for k, v in docs.items():
        free = [True] * len(v)
        for at, n, framing, confidence, *_ in sorted(_slow(v), key=lambda c: (not c[4], -c[3], c[1] - HEADS[c[2]] - (c[2] == "null"), c[0] + HEADS[c[2]], c[2])):
            if all(free[at : at + n]):
                free[at : at + n] = [False] * n
                want.append((k, at, n, framing, confidence))
    assert sorted((r.doc_id, r.start, r.length, r.framing, r.confidence) for r in intervals.strongest_fields(frame).collect()) == sorted(want)


def test_slices_of_several_windows(monkeypatch):
    rng = random.Random(8)
    data = b"".join(_chinese(rng) + bytes(rng.randrange(256) for _ in range(500)) for _ in range(3))
    a = np.frombuffer(data, dtype=np.uint8)
    start = np.array([rng.randrange(len(data) - 5) for _ in range(3000)])
    end = np.minimum(start + np.array([rng.choice([3, 5, 40, 240, 4096]) for _ in start]), len(data))
    want = [legacy.best_codec(data[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    assert legacy.best_codecs(a, start, end).tolist() == want and set(want) >= {-1, 1, 3, 4} - {-1}
    monkeypatch.setattr(legacy, "WINDOW", 700)
    assert legacy.best_codecs(a, start, end).tolist() == want


def test_texts_before_a_zero_byte(spark):
    frame = spark.createDataFrame([(1, bytearray(b"\x01\x02\x03Start\x00ab\x00Quit\x00caf\xc3\xa9\x00end"))], "doc_id long, content binary")
    got = {(r.start, r.length, r.text, r.confidence, r.safe) for r in intervals.framed_candidates(frame).where("safe").collect() if r.framing == "null"}
    assert got == {(12, 5, "Quit", 82, True), (17, 6, "café", 82, True)}
    assert {r.framing for r in intervals.strongest_fields(frame).where("safe").collect()} == {"null", "u8"}


def test_no_document_is_left_out_for_its_size(spark, tmp_path):
    text = "\n".join(f"line number {i} of many" for i in range(450))
    spark.createDataFrame([(1, text, "s"), (2, "short text\nof two lines", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: queries.QUERIES[name](spark, f"file://{tmp_path}").collect()
    for name in ("e11_framed_candidates", "e13_strongest_fields", "e14_format_summary", "x6_spliced", "w6_transactions"):
        assert {r.doc_id for r in run(name)} == {1, 2}, name
    assert sorted(r.nth for r in run("e15_framed_chain") if r.doc_id == 1) == list(range(450))
    assert sum(r.doc_id == 1 for r in run("w5_field_shifts")) == 360
    assert {(r.doc_id, r.asked, r.found) for r in run("j12_patch_fields")} == {(1, 180, 90), (2, 0, 0)}


def test_long_values_are_cut_and_none_is_left_out(spark):
    values = ["é" * 40_000, "", "b", "x" * 65_536, "😀" * 16_001]
    lines = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "doc_id long, idx int, value string")
    chain = rewrite.read_chain(rewrite.framed(lines)).orderBy("start").collect()
    assert "".join(r.text for r in chain) == "".join(values) and max(r.length for r in chain) <= 65_535 and [r.nth for r in chain] == list(range(len(chain)))
    contents, fields = rewrite.framed_mixed(lines)
    data = bytes(contents.first().content)
    rows = fields.orderBy("start").collect()
    assert "".join(r.text for r in rows) == "".join(values) and sum(r.length + 3 for r in rows) == len(data)
    assert all(r.text.encode() in data[r.start : r.start + r.length] for r in rows)


def _slow_texts(b):
    """Texts for players, every offset decoded by Python, the earliest frame first."""
    out, free = [], 0
    for at in range(len(b) - 2):
        n = int.from_bytes(b[at : at + 2], "big")
        raw = b[at + 2 : at + 2 + n]
        if at < free or not n or len(raw) < n:
            continue
        try:
            halves = raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            continue
        text = halves.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")
        if len(text) > 800 or any(ord(c) < 32 and c not in "\t\r\n" for c in text):
            continue
        chinese = any("\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" for c in text)
        if chinese or (sum(c.isalpha() for c in text) >= 2 and any(c in " .,!?;:'\"-" for c in text)):
            out.append((at + 2, n, text.encode("utf-8", "replace").decode()))
            free = at + 2 + n
    return out


def test_player_texts_are_those_found_one_by_one(spark):
    rng = random.Random(11)
    pieces = [x.encode("utf-8", "surrogatepass") for x in ("hi you", "x", "ab", "中", "\ud800\udc00\ud800\udc01-", "\ud800\udc00 ", "\ud800 ab", "\udc00.ab", "a-\ufffdb", "é è", "a\x07b c", "\tab!", "w " * 400, "w " * 401, "\U00010000.b")]
    pieces += [b"\xc0\x80ab c", b"\xed\xa0", b"", b"\xff", b"\x00\x02"]
    contents = [b"", b"\x00", b"\x00\x01", b"\x00\x01a", b"\x00\x03\xe4\xb8\xad", b"\x00\x06hi you", None]
    for _ in range(400):
        c = b""
        for _ in range(rng.randrange(1, 9)):
            p = rng.choice(pieces)
            c += rng.choice([b"", b"\x00", b"\x89PN"]) + max(0, len(p) + rng.choice([0, 0, 0, 1, -1, 3])).to_bytes(2, "big") + p
        contents.append(c)
    docs = spark.createDataFrame([(i, bytearray(c) if c is not None else None, "z") for i, c in enumerate(contents)], "doc_id long, content binary, text string")
    got = sorted(map(tuple, intervals.player_texts(docs).collect()))
    assert got == sorted((i, *x) for i, c in enumerate(contents) if c for x in _slow_texts(c))
    assert len(got) > 300
    assert intervals.player_texts(docs.limit(0)).count() == 0


def test_references_of_classes_are_names_in_tokens(spark):
    rows = [(1, "a/B.class", "x a/C; a/b/Cde(Z)a/b/C/D"), (1, "a/C.class", "a/Bee a/C"), (1, "a/b/C.class", ""), (1, "b/C.class", "q/a/b/Cx"), (1, "Top.class", "Top a/"), (2, "a/B.class", "a/C a/B"), (2, "a/n.txt", "a/B"), (3, None, None)]
    entries = spark.createDataFrame(rows, "archive_id int, source string, content string")
    names = [(a, s[:-6], c or "") for a, s, c in rows if s and s.endswith(".class")]
    want = set()
    for archive, src, content in names:
        for token in re.findall(r"[\w$]+(?:/[\w$]+)+", content):
            want |= {(archive, src, d) for x, d, _ in names if x == archive and d != src and "/" in d and ("/" + token).find("/" + d) >= 0}
    assert {tuple(r) for r in graph.reference_edges(entries).collect()} == want
    assert (1, "a/B", "b/C") in want and (1, "b/C", "a/b/C") in want


def test_contents_that_are_searched_together_do_not_meet():
    contents = [b"\x00\x06hi y", b"ou\x00", b"\x06hi you", b"", b"\x00\x05a\xed\xa0\x80", b"\xed\xb0\x80 b", b"\x00\x04a b\xe4", b"\xb8\xad\x00\x03\xe4\xb8\xad"]
    which, at, end = fields.player_texts(*contents)
    assert [(int(w), int(a) + 2, int(e - a) - 2) for w, a, e in zip(which, at, end, strict=True)] == [(i, s, n) for i, c in enumerate(contents) for s, n, _ in _slow_texts(c)] == [(7, 4, 3)]
    assert [len(x) for x in fields.player_texts()] == [0, 0, 0]
