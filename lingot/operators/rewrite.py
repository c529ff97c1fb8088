"""Rewriting texts and framed fields with translations, whole sources at a time, and checking the result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import slices
from ..functions.text import SPACE
from .splice import frame


def _parts(line: Column, space: str) -> tuple[Column, Column, Column]:
    """What stands before the value of a line (key= and white space), the value, and white space after it."""
    head = F.when(line.contains("="), F.regexp_extract(line, r"(?s)^([^=]*=)", 1)).otherwise("")
    body = F.substr(line, F.char_length(head) + 1)
    left, right = F.regexp_extract(body, f"^({space}*)", 1), F.regexp_extract(body, rf"({space}*)\z", 1)
    value = F.regexp_replace(body, rf"^{space}+|{space}+\z", "")
    return F.concat(head, left), value, F.when(value == "", "").otherwise(right)


def rewrite_texts(docs: DataFrame, patches: DataFrame, encodable: str | None = None, space: str = SPACE) -> tuple[DataFrame, DataFrame]:
    """(texts, items): documents with patches(doc_id, idx, original, translation) spliced in, and what became of each patch.

    A patch whose line doesn't exist is SKIPPED, one whose line no longer holds the original FAILED, else PATCHED.
    If the new text doesn't match ``encodable`` (a regex of the whole text) the document keeps its old text and
    all its patches are FAILED.  Line endings, ``key=`` and white space (what ``space`` matches) around values stay.
    What follows the last line ending is a line, as it is to ``tables.lines``, also where it is empty.
    """
    pieces = F.regexp_extract_all("text", F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\z|(?<![^\r\n])\z"), F.lit(0))
    lines = docs.select("doc_id", F.posexplode(pieces).alias("idx", "piece"))
    lines = lines.withColumn("line", F.regexp_extract("piece", r"^([^\r\n]*)", 1)).withColumn("ending", F.regexp_extract("piece", r"([\r\n]*)$", 1))
    head, value, tail = _parts(F.col("line"), space)
    joined = lines.join(patches.select("doc_id", "idx", "original", "translation"), ["doc_id", "idx"], "full_outer")
    status = F.when(F.col("original").isNull(), F.lit(None)).when(F.col("piece").isNull(), "SKIPPED").when(value != F.col("original"), "FAILED").otherwise("PATCHED")
    joined = joined.withColumn("status", status).withColumn("new", F.when(F.col("status") == "PATCHED", F.concat(head, "translation", tail, "ending")).otherwise(F.col("piece")))
    texts = joined.where("piece is not null").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("idx", "new"))).getField("new"), "").alias("new_text"), F.array_join(F.array_sort(F.collect_list(F.struct("idx", "piece"))).getField("piece"), "").alias("old_text"))
    fits = F.col("new_text").rlike(encodable) if encodable else F.lit(True)
    texts = texts.withColumn("rolled_back", ~fits)
    items = joined.where("status is not null").select("doc_id", "idx", "original", "translation", "status").join(texts.select("doc_id", "rolled_back"), "doc_id", "left")
    items = items.withColumn("status", F.when(F.coalesce("rolled_back", F.lit(False)) & (F.col("status") == "PATCHED"), "FAILED").otherwise(F.col("status"))).drop("rolled_back")
    return texts.select("doc_id", F.when(F.col("rolled_back"), F.col("old_text")).otherwise(F.col("new_text")).alias("text"), "rolled_back"), items


def report_counts(items: DataFrame, group: str) -> DataFrame:
    got = items.groupBy(group).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PATCHED", "SKIPPED", "FAILED")])
    return got.withColumn("ok", F.col("failed") == 0)


def validate_rebuild(expected: DataFrame, outputs: DataFrame, slots: DataFrame) -> DataFrame:
    """PASS, FAIL or SKIPPED for each expected(doc_id, idx, kind, translation) against the rebuilt outputs(doc_id, content) and class strings slots(doc_id, idx, value).

    A source that is not there fails all its rows.  A class string must equal a string of its class; a text, and a safe binary
    field, must stand anywhere in the content, a text in one that is UTF-8; unsafe binary fields and other kinds are skipped.
    The rows of a source meet its content once, as an array.
    """
    rows = expected.groupBy("doc_id").agg(F.collect_list(F.struct("idx", "kind", "translation")).alias("_rows"))
    values = slots.groupBy("doc_id").agg(F.collect_set("value").alias("_values"))
    rows = rows.join(outputs.select("doc_id", F.col("content").alias("_content")), "doc_id", "left").join(values, "doc_id", "left")
    text = F.when(F.is_valid_utf8(F.col("_content").cast("string")), F.col("_content").cast("string"))

    def status(r: Column) -> Column:
        kind, wanted = r["kind"], r["translation"]
        held = F.when(kind == "class-string", F.array_contains("_values", wanted)).when(kind == "resource-text", F.contains(text, wanted)).when(kind.startswith("binary:") & ~kind.endswith(":unsafe"), F.contains(F.col("_content"), F.encode(wanted, "utf-8")))
        tried = (kind == "class-string") | (kind == "resource-text") | (kind.startswith("binary:") & ~kind.endswith(":unsafe"))
        return F.when(F.col("_content").isNull(), "FAIL").when(~tried, "SKIPPED").when(F.coalesce(held, F.lit(False)), "PASS").otherwise("FAIL")

    told = F.transform("_rows", lambda r: F.struct(r["idx"].alias("idx"), r["kind"].alias("kind"), r["translation"].alias("translation"), status(r).alias("status")))
    return rows.select("doc_id", F.explode(told).alias("_r")).select("doc_id", "_r.*")


#: Characters of a field at most; longer values are cut into several fields, so that none exceeds a 16-bit length in UTF-8.
FIELD_CHARS = 16_000


def cut(lines: DataFrame) -> DataFrame:
    """lines(doc_id, idx, value) with part: values of more than FIELD_CHARS characters as several; empty ones, which make no field, go."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("value") - 1) / FIELD_CHARS)), lambda k: F.substr(F.col("value"), (k * FIELD_CHARS + 1).cast("int"), F.lit(FIELD_CHARS)))
    return lines.where("value <> ''").select("doc_id", "idx", F.posexplode(parts).alias("part", "value"))


def framed(lines: DataFrame) -> DataFrame:
    """(doc_id, content, fields): every value that isn't empty as a 16-bit big-endian length and its UTF-8 bytes, one after the other; long ones are ``cut``."""
    got = cut(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "part", frame(F.col("value"), F.lit("u16be")).alias("frame")))).alias("f"))
    return got.select("doc_id", F.size("f").alias("fields"), F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["frame"])), "")).alias("content"))


def framed_mixed(lines: DataFrame, between: str = "FFFE01") -> tuple[DataFrame, DataFrame]:
    """Contents (doc_id, content) of fields in all framings by place, with bytes that are no field between them, and their fields.

    fields(doc_id, idx, start, length, framing, safe, text); a text with a zero character, or too long for 8 bits, has a 16-bit length.
    """
    turn = F.col("idx") % 4
    framing = F.when((turn == 1) & (F.octet_length("value") <= 240), "u8").when(turn == 2, "u16le").when((turn == 3) & ~F.contains("value", F.lit("\0")), "null").otherwise("u16be")
    rows = cut(lines).withColumn("framing", framing).withColumn("frame", frame(F.col("value"), F.col("framing"))).withColumn("length", F.octet_length("frame"))
    gap = len(between) // 2
    order = Window.partitionBy("doc_id").orderBy("idx", "part")
    before = F.coalesce(F.sum(F.col("length") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fields = rows.withColumn("start", (before + gap).cast("int"))
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "part", "frame"))).alias("f"))
    contents = got.select("doc_id", F.unhex(F.array_join(F.transform("f", lambda x: F.concat(F.lit(between), F.hex(x["frame"]))), "")).alias("content"))
    return contents, fields.select("doc_id", "idx", "start", "length", "framing", F.lit(True).alias("safe"), F.col("value").alias("text"))


def _chain(data: bytes, most: int) -> list[tuple[int, int, str]]:
    """Follows the lengths from the start of a content, for so many fields or until fewer than two bytes are left."""
    out, at = [], 0
    while len(out) < most and at + 2 <= len(data):
        n = data[at] * 256 + data[at + 1]
        out.append((at, n, data[at + 2 : at + 2 + n].decode("utf-8", "replace")))
        at += 2 + n
    return out


def read_chain(frames: DataFrame) -> DataFrame:
    """(doc_id, nth, start, length, text): fields of contents of any size that are chains of 16-bit lengths and texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, contents, fields in slices(batches, "doc_id", "content", "fields"):
            found = [_chain(b, n) for b, n in zip(contents.to_pylist(), fields.to_pylist(), strict=True)]
            place = pa.array([i for i, chain in enumerate(found) for _ in chain], pa.int64())
            nth = pa.array([k for chain in found for k in range(len(chain))], pa.int32())
            rows = [pa.array([f[k] for chain in found for f in chain], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([ids.take(place), nth, *rows], ["doc_id", "nth", "start", "length", "text"])

    ids = T.StructField("doc_id", frames.schema["doc_id"].dataType)
    numbers = [T.StructField(c, T.IntegerType()) for c in ("nth", "start", "length")]
    return frames.select("doc_id", "content", "fields").mapInArrow(read, T.StructType([ids, *numbers, T.StructField("text", T.StringType())]))


def publishable(archives: DataFrame) -> DataFrame:
    """Adds refused: why an archive (entries array, output, input, changed) may not be published, else null."""
    signed = F.exists("entries", lambda e: F.upper(e).rlike(r"^META-INF/[^/]+\.(?:SF|RSA|DSA|EC)$"))
    return archives.withColumn("refused", F.when(signed, "signed").when(F.col("output") == F.col("input"), "same path").when(~F.col("changed"), "no change"))
