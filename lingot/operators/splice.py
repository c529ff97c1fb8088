"""Patches of framed text fields in binary contents: an edit script for each content, its splice, and a check of the result.

A content is one transaction.  Each patch must meet a safe field at its offset with its text and framing, and the
translation must fit the field's length; one that fails fails all patches of the content.  The new content is made of
slices of the old one between the fields and of new frames.  Then every frame is looked for where prefix sums of the
size changes say that it must stand; a content in which one isn't found stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest text of each framing in bytes; text before a zero byte may have any length.
LONGEST = {"u8": 255, "u16be": 65_535, "u16le": 65_535}


def frame(text: Column, framing: Column) -> Column:
    """The bytes of a field: its length and text, or its text and a zero byte; null for an unknown framing or a text that is too long."""
    data, n = F.encode(text, "utf-8"), F.octet_length(text)
    length = F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0"))
    return (
        F.when((framing == "u16be") & (n <= LONGEST["u16be"]), F.concat(length, data))
        .when((framing == "u16le") & (n <= LONGEST["u16le"]), F.concat(F.substring(length, 2, 1), F.substring(length, 1, 1), data))
        .when((framing == "u8") & (n <= LONGEST["u8"]), F.concat(F.substring(length, 2, 1), data))
        .when(framing == "null", F.concat(data, F.unhex(F.lit("00"))))
    )


def head(framing: Column) -> Column:
    """Bytes of a frame before its text."""
    return F.when(framing == "u8", 1).when(framing.isin("u16be", "u16le"), 2).otherwise(0)


def preflight(patches: DataFrame, fields: DataFrame) -> DataFrame:
    """patches(doc_id, offset, text, kind, translation) with framing, start and length of the field that each is for, and met.

    kind is ``binary:<framing>:safe``; a patch of another kind is not tried (met is null).  offset is that of the text;
    fields(doc_id, start, length, framing, safe, text) have the frame's start and length.  met is false if no such field is
    there, it is not safe, or another patch is for it too.
    """
    told = F.regexp_extract("kind", r"^binary:([^:]*):safe$", 1)
    rows = patches.withColumn("framing", F.nullif(told, F.lit("")))
    there = fields.select("doc_id", (F.col("start") + head(F.col("framing"))).alias("offset"), "text", "framing", "start", "length", "safe")
    rows = rows.join(there, ["doc_id", "offset", "text", "framing"], "left")
    rows = rows.withColumn("_n", F.count("start").over(Window.partitionBy("doc_id", "start")))
    met = F.coalesce("safe", F.lit(False)) & (F.col("_n") < 2)
    return rows.select(*patches.columns, "framing", "start", "length", F.when(F.col("framing").isNotNull(), met).alias("met"))


def edit_plan(checked: DataFrame) -> DataFrame:
    """``preflight``'s rows with frame, status, delta and shift: what replaces each field, its size change, and how far it moves.

    SKIPPED: not tried; FAILED: this or another patch of the content isn't met or doesn't fit; else READY.
    """
    rows = checked.withColumn("frame", F.when(F.col("met"), frame(F.col("translation"), F.col("framing"))))
    bad = F.col("met").isNotNull() & F.col("frame").isNull()
    rows = rows.withColumn("_failed", F.max(bad).over(Window.partitionBy("doc_id")))
    status = F.when(F.col("met").isNull(), "SKIPPED").when(F.col("_failed"), "FAILED").otherwise("READY")
    rows = rows.withColumn("status", status).drop("_failed")
    delta = F.when(F.col("status") == "READY", F.octet_length("frame") - F.col("length")).otherwise(0)
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # the fields of one content
    moved = F.when(F.col("status") == "READY", F.coalesce(F.sum("delta").over(before), F.lit(0))).otherwise(0)
    return rows.withColumn("delta", delta.cast("int")).withColumn("shift", moved.cast("long"))


def _joined(content: Column, edits: Column) -> Column:
    """A content with edits (start, length, frame, in order) in the place of their fields."""
    behind = lambda e: e["start"] + e["length"]
    piece = lambda since, until: F.hex(F.substr(content, (since + 1).cast("int"), (until - since).cast("int")))
    # what stands between the field before and this one, and the new frame
    pieces = F.transform(edits, lambda e, i: F.concat(piece(F.when(i == 0, 0).otherwise(behind(F.get(edits, i - 1))), e["start"]), F.hex(e["frame"])))
    return F.unhex(F.concat(F.array_join(pieces, ""), piece(behind(F.element_at(edits, -1)), F.octet_length(content))))


def spliced(contents: DataFrame, plan: DataFrame) -> DataFrame:
    """contents(doc_id, content) after the plan, with ok: false where a frame isn't found at its shifted place and the old content stays."""
    ready = plan.where("status = 'READY'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "frame", "shift"))).alias("_edits"))
    rows = contents.select("doc_id", "content").join(ready, "doc_id", "left")
    rows = rows.withColumn("_new", F.when(F.col("_edits").isNotNull(), _joined(F.col("content"), F.col("_edits"))).otherwise(F.col("content")))
    stands = lambda e: F.substr(F.col("_new"), (e["start"] + e["shift"] + 1).cast("int"), F.octet_length(e["frame"])) == e["frame"]
    sizes = F.octet_length("_new") == F.octet_length("content") + F.aggregate("_edits", F.lit(0), lambda n, e: n + F.octet_length(e["frame"]) - e["length"])
    ok = F.coalesce(F.forall("_edits", stands) & sizes, F.lit(True))
    return rows.withColumn("ok", ok).select("doc_id", F.when(F.col("ok"), F.col("_new")).otherwise(F.col("content")).alias("content"), "ok")


def outcomes(plan: DataFrame, results: DataFrame) -> DataFrame:
    """The plan's rows with their last status: READY ones are PATCHED, or FAILED where their content stayed as it was or isn't there."""
    rows = plan.join(results.select("doc_id", F.col("ok").alias("_ok")), "doc_id", "left")
    done = F.when(F.coalesce("_ok", F.lit(False)), "PATCHED").otherwise("FAILED")
    return rows.withColumn("status", F.when(F.col("status") == "READY", done).otherwise(F.col("status"))).drop("_ok")
