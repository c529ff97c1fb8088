"""Views of the given tables on which the operators run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dealing import dealt

SEPARATOR = "␟"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """(doc_id, source, idx, value, kind): the lines of every document, on request of ``dealt`` ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = dealt(docs, "doc_id") if deal else docs
    return docs.select("doc_id", "source", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("idx", "value")).withColumn("kind", F.lit("resource-text"))


def lines_after(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """``lines`` with before: the value of the line before each, null for the first of a document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = (dealt(docs, "doc_id") if deal else docs).select("doc_id", "source", F.split("text", r"\r\n|\r|\n").alias("_lines"))
    pairs = F.transform("_lines", lambda v, i: F.struct(v.alias("value"), F.get(F.col("_lines"), i - 1).alias("before")))
    return docs.select("doc_id", "source", F.posexplode(pairs).alias("idx", "_l")).select("doc_id", "source", "idx", "_l.value", "_l.before", F.lit("resource-text").alias("kind"))


def key_of(idx: Column, value: Column) -> Column:
    """The key of the line of that place and value in its document and source."""
    return F.concat_ws(SEPARATOR, F.col("doc_id").cast("string"), "source", "kind", idx.cast("string"), value)


def with_key(strings: DataFrame) -> DataFrame:
    """Adds key: document, source, kind, place and value, joined."""
    return strings.withColumn("key", key_of(F.col("idx"), F.col("value")))


def strings(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    return with_key(lines(spark, sf_dir, deal))


def translations(strings: DataFrame, *carried: str) -> DataFrame:
    """(key, translation, and carried columns) for three of four strings, by document and place: changed, unchanged, empty."""
    turn = (F.col("doc_id") + F.col("idx")) % 4
    text = F.when(turn == 0, F.concat(F.lit("vi: "), F.col("value"))).when(turn == 1, F.col("value")).otherwise(F.lit("  "))
    return strings.where(turn < 3).select(*carried, "key", text.alias("translation"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, line_no, line, ts): events of a user told as a runtime log, in order of time."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    line_no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    turn = F.col("event_id") % 7
    name = F.concat(F.lit("com.game.Scene"), (F.col("event_id") % 5).cast("string"))
    line = (
        F.when(turn == 0, F.concat(F.lit("java.lang.NullPointerException: "), F.col("event_type")))
        .when(turn == 1, F.concat(F.lit("    at "), name, F.lit(".run(Scene.java:1)")))
        .when(turn == 2, F.concat(F.lit("Caused by: java.lang.ClassNotFoundException: javax/bluetooth/"), F.col("event_type")))
        .when(turn == 3, F.concat(F.lit("    at javax.microedition.media.Player"), (F.col("event_id") % 3).cast("string"), F.lit(".start(Player.java:2)")))
        .when(turn == 4, F.concat(F.lit("WARNING: could be slow in res/"), F.col("event_type"), F.lit(".png")))
        .otherwise(F.concat(F.lit("info "), F.col("event_type")))
    )
    return e.select(F.col("user_id").alias("log_id"), line_no.cast("int").alias("line_no"), line.alias("line"), "ts")
