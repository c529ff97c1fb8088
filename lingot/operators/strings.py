"""Filtering, deduplication, ranking and statistics of extracted strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.language import classify, settled, threshold
from ..functions.text import any_in, label_form, letter_count, normal_space, several_words
from ..plans.ranks import ordered_place


def _normal(strings: DataFrame) -> DataFrame:
    return settled(strings.withColumn("_norm", normal_space("value")), "_norm")


def scored(strings: DataFrame) -> DataFrame:
    """strings with their score, that later steps need not find again."""
    return settled(classify(_normal(strings), normal="_norm").drop("_norm", "reasons"), "score")


def accepted(strings: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Strings at or above their threshold; of equal normalised values of a group the first accepted.  Strings that carry a score keep it."""
    good = F.col("score") >= threshold(F.col("kind"))
    rows = _normal(strings.where(good)) if "score" in strings.columns else settled(classify(_normal(strings), normal="_norm"), "score").where(good)
    rows = rows.where(F.col("_norm") != "")
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*group, "_norm").orderBy(*order))).where("_nth = 1").drop("_nth", "_norm")


def filter_counts(strings: DataFrame, group: str) -> DataFrame:
    """accepted and rejected rows of each group; strings that carry a score keep it."""
    ok = F.col("score") >= threshold(F.col("kind"))
    rows = strings if "score" in strings.columns else classify(strings)
    return rows.groupBy(group).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def first_of_key(strings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return strings.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def candidate_scores(strings: DataFrame, group: list[str]) -> DataFrame:
    """Score of every source from the scores of its strings, 0 to 100, with what it rests on; strings that carry a score keep it."""
    scored = (strings if "score" in strings.columns else classify(strings)).withColumns({"_ui": label_form("value").isin(*K.UI_WORDS), "_multi": several_words("value")})
    got = scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("score") >= 40).alias("strong"),
        F.count_if(F.col("score").between(20, 39)).alias("medium"),
        F.avg("score").alias("mean"),
        F.count_if("_ui").alias("ui"),
        F.count_if("_multi").alias("multi"),
    )
    n, strong, mean = F.col("n"), F.col("strong"), F.col("mean")
    points = F.least(F.lit(35), 5 * strong) + F.least(F.lit(15), 2 * F.col("medium")) + F.least(F.lit(30), 6 * F.col("ui"))
    points += F.when(any_in(F.lower("source"), K.PATH_HINTS), 22).otherwise(0)
    points += F.when(F.col("multi") / n >= 0.30, 12).otherwise(0)
    points += F.when(mean >= 35, 15).when(mean >= 22, 8).otherwise(0)
    points += F.when(n >= 5, 5).otherwise(0) + F.when((n >= 20) & (strong / n >= 0.30), 5).otherwise(0)
    return got.withColumn("candidate_score", F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int"))


def ranked_candidates(strings: DataFrame, group: list[str]) -> DataFrame:
    return candidate_scores(strings, group).orderBy(F.desc("candidate_score"), F.desc("n"), *group)


def exportable(kind: Column) -> Column:
    return kind.startswith("class-string") | (kind == "resource-text") | (kind.startswith("binary:") & kind.endswith(":safe"))


def row_status(value: Column, translation: Column) -> Column:
    text = F.btrim(F.coalesce(translation, F.lit("")))
    return F.when(text == "", "untranslated").when(text == value, "needs review").otherwise("translated")


def search(rows: DataFrame, needle: str, status: str | None = None, source: str | None = None) -> DataFrame:
    """Rows whose value, translation or source holds the needle, in any case; with a status or source if asked."""
    low = needle.lower()
    hit = F.lower("value").contains(low) | F.lower(F.coalesce("translation", F.lit(""))).contains(low) | F.lower("source").contains(low)
    rows = rows.where(hit)
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.where(F.col("source") == source) if source else rows


def shown_rows(rows: DataFrame, order: list[str], most: int = 3000) -> DataFrame:
    """The first ``most`` rows, each with the count of all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total))  # one number beside a capped list


def progress(rows: DataFrame) -> DataFrame:
    """Translation progress by document, by source and overall (rollup)."""
    done = F.col("status") != "untranslated"
    got = rows.rollup("source", "doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("translated"))
    ratio = F.col("translated") / F.col("total")
    return got.withColumn("untranslated", F.col("total") - F.col("translated")).withColumn("ratio", F.round(ratio, 6)).withColumn("percent", F.bround(ratio * 100, 0).cast("int"))


def export_ids(rows: DataFrame, group: str, order: list[str], together: bool = False) -> DataFrame:
    """id T00001, T00002, ... of the exportable rows of a group, in order; a group of any size is numbered by ranges.

    ``together``: a group's rows go into one file afterwards, and are numbered where they are gathered.
    """
    asked = rows.where(exportable(F.col("kind")))
    numbered = asked.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")) if together else ordered_place(asked, [group], order, "_place")
    return numbered.withColumn("id", F.format_string("T%05d", "_place")).drop("_place")


def looks_human(c: Column) -> Column:
    """2 to 800 characters with a letter, no path or descriptor, mostly printable letters."""
    s = F.btrim(c)
    n = F.char_length(s)
    printable = n - F.regexp_count(s, F.lit(r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \t\r\n]]"))  # few are not
    code = (n > 12) & s.rlike(r"^[A-Za-z0-9_/$.;<>\[\]():+-]+$") & (s.contains("/") | s.contains(";") | (F.regexp_count(s, F.lit(r"\.")) >= 2))
    score = printable / n * 0.55 + letter_count(s) / n * 0.55 - F.regexp_count(s, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")) * 0.2
    return n.between(2, 800) & s.rlike(r"\p{L}") & ~code & (score >= 0.55)
