"""Publishing rewritten sources: readiness, build, regression, and promotion of what passed as one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..plans import versions
from ..plans.scratch import kept
from .rewrite import rewrite_texts, validate_rebuild


def publish(docs: DataFrame, patches: DataFrame, expected: DataFrame, ready: DataFrame, path: str, version: int, allow_warnings: Column | None = None, encodable: str | None = None, space: str = SPACE) -> DataFrame:
    """(doc_id, status, patched, skipped, failed, checked, missing): what becomes of every source of ready(doc_id, status).

    BLOCKED and WARNING: not built, the latter unless allow_warnings says so of the source.  The others are rewritten with
    their patches into a staged table, and expected(doc_id, idx, kind, translation) is looked for there: PASS if nothing is missing, else FAIL.  The sources that
    pass become ``version`` of the store at ``path`` (doc_id, content) in one step; a run that is repeated promotes nothing twice.
    """
    spark = docs.sparkSession
    allowed = F.lit(False) if allow_warnings is None else allow_warnings
    held = F.when(F.col("status") == "BLOCKED", "BLOCKED").when((F.col("status") == "WARNING") & ~allowed, "WARNING")
    gated = kept(ready.select("doc_id", held.alias("held")), "readiness")
    going = gated.where("held is null").select("doc_id")
    texts, items = rewrite_texts(docs.join(going, "doc_id", "left_semi"), patches.join(going, "doc_id", "left_semi"), encodable, space)
    staged = kept(texts.select("doc_id", F.col("text").cast("binary").alias("content")), "staged")
    no_slots = spark.createDataFrame([], "doc_id long, idx int, value string")
    checks = validate_rebuild(expected.join(going, "doc_id", "left_semi"), staged, no_slots)
    checks = kept(checks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "FAIL").alias("missing")), "regression")
    counts = items.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PATCHED", "SKIPPED", "FAILED")])
    rows = gated.join(checks, "doc_id", "left").join(counts, "doc_id", "left").fillna(0, ["checked", "missing", "patched", "skipped", "failed"])
    status = F.coalesce("held", F.when(F.col("missing") > 0, "FAIL").otherwise("PASS"))
    rows = kept(rows.select("doc_id", status.alias("status"), "patched", "skipped", "failed", "checked", "missing"), "publish-report")
    passed = staged.join(rows.where("status = 'PASS'").select("doc_id"), "doc_id", "left_semi")
    versions.commit(spark, path, passed, version, key="doc_id")
    return rows
