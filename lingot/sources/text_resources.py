"""Strings out of text resources and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped as _strip


def _line_rows(docs: DataFrame, text: str) -> DataFrame:
    """Stripped lines that are neither blank nor comments, with their place."""
    rows = docs.select("*", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("idx", "_line"))
    rows = rows.withColumn("_line", _strip("_line"))
    return rows.where((F.col("_line") != "") & ~F.col("_line").rlike("^(?:#|;|//)"))


def text_strings(docs: DataFrame, text: str = "text") -> DataFrame:
    """idx and value: of every line what follows the first =, else the line."""
    rows = _line_rows(docs, text)
    line = F.col("_line")
    value = F.when(line.contains("="), _strip(F.regexp_extract(line, r"(?s)^[^=]*=(.*)$", 1))).otherwise(line)
    return rows.withColumn("value", value).where("value <> ''").drop("_line")


def key_value_strings(docs: DataFrame, text: str = "text") -> DataFrame:
    """As text_strings, but ``key: value`` counts as well where the key is short, and an empty right side keeps the line."""
    rows = _line_rows(docs, text)
    line = F.col("_line")
    after_equals = _strip(F.regexp_extract(line, r"(?s)^[^=]*=(.*)$", 1))
    left, after_colon = F.regexp_extract(line, r"^([^:]*):", 1), _strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
    colon = line.contains(":") & (F.char_length(left) < 40)
    value = F.when(line.contains("="), F.when(after_equals != "", after_equals).otherwise(line)).when(colon & (after_colon != ""), after_colon).otherwise(line)
    return rows.withColumn("value", value).drop("_line")


def manifest_entries(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, value): continuation lines joined, keys in lower case, the last of equal keys."""
    joined = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n ", "")
    rows = docs.select(id_column, F.posexplode(F.split(joined, "\n")).alias("pos", "line")).where(F.col("line").contains(":"))
    rows = rows.select(id_column, "pos", F.lower(_strip(F.regexp_extract("line", r"^([^:]*):", 1))).alias("key"), _strip(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1)).alias("value"))
    return rows.groupBy(id_column, "key").agg(F.max_by("value", "pos").alias("value"))
