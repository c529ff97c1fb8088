"""The scan job: extraction, language filter, candidate ranking, with a deep pass where the fast one finds little."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import classify, settled, threshold
from ..functions.text import extension, normal_space
from ..plans.dealing import dealt
from ..plans.scratch import kept
from ..sources.archives import should_scan
from ..sources.text_resources import key_value_strings, text_strings
from .strings import accepted, looks_human

FEW = 5


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, source, idx, value, kind, score): accepted strings of documents(doc_id, source, text).

    Documents of which the fast pass accepts fewer than ``FEW`` strings get the deep pass, the others keep the fast one.
    """
    fast = settled(text_strings(docs), "value").withColumn("kind", F.lit("resource-text")).select("doc_id", "source", "idx", "value", "kind")
    fast = kept(accepted(fast, ["doc_id"], ["idx"]).select("doc_id", "source", "idx", "value", "kind", "score"), "fast-strings")
    enough = fast.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW).select("doc_id")
    deep = settled(key_value_strings(docs.join(enough, "doc_id", "left_anti")).select("doc_id", "source", "idx", "value", F.lit("deep-text").alias("kind")), "value")
    deep = accepted(deep.where(looks_human(F.col("value"))), ["doc_id"], ["idx"])
    return fast.join(enough, "doc_id", "left_semi").unionByName(deep.select("doc_id", "source", "idx", "value", "kind", "score"))


def entry_points(manifest: DataFrame, classes: DataFrame) -> DataFrame:
    """(archive_id, root): last comma part of MIDlet-n values of manifest(archive_id, key, value) that is a class of the archive."""
    root = F.trim(F.element_at(F.split("value", ","), -1))
    return manifest.where(F.col("key").rlike(r"(?i)^midlet-[0-9]+$")).select("archive_id", root.alias("root")).join(classes.select("archive_id", F.col("name").alias("root")), ["archive_id", "root"], "left_semi")


def scan_diagnostics(entries: DataFrame) -> DataFrame:
    """What a scan of each archive read, skipped, found and rejected; entries(archive_id, source, size, text).

    Class entries that don't begin as class files do count as failed; equal strings of an entry count once after the filter.
    """
    is_class = extension("source") == "class"
    entries = dealt(entries, "archive_id", "source")  # an entry's strings stay where it is
    rows = entries.withColumns({"_read": should_scan(F.col("source"), F.col("size"), deep=True), "_fast": should_scan(F.col("source"), F.col("size"))})
    deep = F.col("_read") & ~F.col("_fast")
    counts = rows.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("entries_total"), F.count_if("_read").alias("entries_read"), F.count_if(deep).alias("entries_deep_scanned"), F.count_if(~F.col("_read")).alias("entries_skipped_media_or_size"),
        F.count_if(F.col("_read") & is_class & ~F.coalesce(F.hex(F.encode(F.substring("text", 1, 4), "ISO-8859-1")) == "CAFEBABE", F.lit(False))).alias("class_parse_failed"),
    )
    columns = ("archive_id", "source", "idx", "value", "kind")
    fast_strings = settled(text_strings(rows.where(F.col("_fast") & ~is_class)), "value").withColumn("kind", F.lit("resource-text")).select(*columns)
    deep_strings = settled(key_value_strings(rows.where(deep)), "value").where(looks_human(F.col("value"))).withColumn("kind", F.lit("deep-text")).select(*columns)
    found = settled(fast_strings.unionByName(deep_strings).withColumn("_norm", normal_space("value")), "_norm")
    scored = settled(classify(found, normal="_norm"), "score")
    good = (F.col("score") >= threshold(F.col("kind"))) & (F.col("_norm") != "")
    once = scored.groupBy("archive_id", "source", "_norm").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.count_if(F.col("kind") == "deep-text").alias("deep"))
    by_entry = once.groupBy("archive_id", "source").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("deep").alias("deep"), F.count_if(F.col("good") > 0).alias("kept"))
    sums = by_entry.groupBy("archive_id").agg(
        F.sum("n").alias("strings_before_filter"), F.sum("kept").alias("strings_after_filter"), F.sum(F.col("n") - F.col("good")).alias("strings_rejected_non_language"),
        F.sum("deep").alias("deep_strings"), F.count_if(F.col("kept") > 0).alias("candidates"), F.sum("kept").alias("total_strings"),
    )
    return counts.join(sums, "archive_id", "left").fillna(0)


def report_pair(reports: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """(archive_id, text, json): both halves of a report."""
    return report_text(reports.withColumn("json", F.to_json(F.struct(*fields))), title, fields, "json")


def report_text(reports: DataFrame, title: str, fields: list[str], *carried: str) -> DataFrame:
    """(archive_id, text and carried columns): a title and one ``name: value`` line for each field."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("unknown"))) for f in fields]
    return reports.select("archive_id", F.concat_ws("\n", F.lit(title), *lines).alias("text"), *carried)
