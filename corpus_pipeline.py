"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the weakly supervised classifier calls toxic go.
2. near_dedup: one document of each group of near-duplicates stays (the smallest doc_id).
3. substring_dedup: words of passages of 20 words and more that an earlier text holds go.
4. mixing: documents appear as often as the mix of sources takes them, in training order.
5. packing: pieces of at most 4,096 tokens with their places in sequences.

All stages but the last return the columns of ``documents``.  Stage 4 repeats rows, so its doc_ids repeat,
and so do the (doc_id, piece) pairs of stage 5, once for each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingot.llm.bag_minhash import near_duplicates
from lingot.llm.mixing import mixed_documents
from lingot.llm.packing import pack
from lingot.llm.queries import tokenizer_path
from lingot.llm.shared import apart, checked, kept, table, together
from lingot.llm.substring_dedup import without_repeats
from lingot.llm.toxicity import toxicity as toxicity_scores


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs without the rows of these doc_ids; the ids are broadcast only if they are counted to be few."""
    return docs.join(checked(ids.select("doc_id").distinct(), name), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text is toxic go, whatever their doc_id; a score depends on the text alone, so texts are told by 128 bits of hash."""
    docs, names = apart(docs)
    marks = {"_text_a": F.xxhash64("text"), "_text_b": F.xxhash64(F.lit(1), "text")}
    scored = toxicity_scores(docs.withColumns(marks), table(spark, sf_dir, "labels"), carried=tuple(marks))
    toxic = checked(scored.where("predicted = 1").select(*marks).distinct(), "toxic-texts")
    return docs.withColumns(marks).join(toxic, list(marks), "left_anti").select(*docs.columns).transform(together, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the least doc_id stays; rows without a doc_id or without words are no copies and stay; rows that share a doc_id go or stay together."""
    return _without(docs, near_duplicates(docs).where(~F.col("kept")), "near-copies")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose nothing keep their white space; the others are their kept words, joined by one space."""
    docs, names = apart(docs)
    found = without_repeats(docs)
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    chars = F.when(F.col("_n_removed") > 0, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).withColumn("text", text).select(*docs.columns).transform(together, names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in training order, as often as the mix takes them; texts without words once; no rows give no rows."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row; a null or empty text is the end id alone; no rows give no rows."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Neither the classifier nor the tokenizer is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
