"""Mixing sources to target weights under a curriculum that changes over training time.

Every source has a weight schedule, linear from a start to an end value over training time 0..1 and
scaled so that its integral is the source's target.  Its documents queue in a hashed order, pass after
pass; the words queued before a document, put through the inverse of the source's cumulative demand,
give the document's training position.  A range sort by position is the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import apart, checked, kept, ranked, together

#: Weights by the rank of the source, repeating; and how a schedule ends relative to its start.
WEIGHTS = (5.0, 2.0, 1.0)
TILTS = (0.5, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source_key, source_size, rank, weight, target) from (source_key, source_size), one row per source.

    ``share`` of all sizes is dealt by weight; targets stop at ``most`` times the source's size, and what is
    above is dealt again until none is.  source_key is null-safe and sorts by code point with null last.
    The rows are one per source; each round of dealing is one aggregate over them.
    """
    ranks = Window.orderBy("source_key")  # one row per source, never one per document
    rows = sizes.withColumn("rank", F.row_number().over(ranks) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = kept(rows.withColumn("weight", weight), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        cap = F.col("source_size") * most
        full = F.col("weight") * level >= cap
        r = rows.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = (share * total - r["capped"]) / r["open"]
        if new <= level:
            break
        level = new
    return rows.withColumn("target", F.least(F.col("source_size") * most, F.col("weight") * level).cast("double"))


def _position(queued: Column, target: Column, tilt: Column) -> Column:
    """The time at which a schedule 1 -> tilt, scaled to integrate to target, has asked for ``queued`` words."""
    mean = (1 + tilt) / 2
    y = F.when(target > 0, F.least(F.lit(1.0), queued / target)).otherwise(0.0) * mean
    slope = tilt - 1
    return F.when(F.abs(slope) < 1e-12, y).otherwise((F.sqrt(F.greatest(F.lit(0.0), 1 + 2 * slope * y)) - 1) / slope)


def _source_key(docs: DataFrame) -> DataFrame:
    """source_key: sorts as the source does, null last; never null itself."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    return docs.withColumn("_key", key)


def _plan(docs: DataFrame, seed: int) -> DataFrame:
    """What ``mix`` tells of every row, in no order, and position_again: that of the second copy, null where there is none."""
    words = _source_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), "source"))
    words = kept(words.select("doc_id", "size", "_key"), "mix-sizes")
    sizes = words.groupBy(F.col("_key").alias("source_key")).agg(F.sum("size").alias("source_size"))
    targets = checked(source_targets(sizes), "mix-targets")
    queue = ranked(words, "_key", [F.col("doc_id"), F.col("size")], [F.lit(seed), F.col("doc_id"), F.col("size")], "before", weight=F.col("size"))
    rows = queue.join(targets, F.col("_key") == F.col("source_key"))
    goal = F.round("target").cast("long")
    words_from = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), goal - start))
    taken = words_from(F.col("before")) + words_from(F.col("before") + F.col("source_size"))
    tilt = F.element_at(F.array(*[F.lit(t) for t in TILTS]), (F.col("rank") % len(TILTS) + 1).cast("int"))
    place = lambda start: _position(start, F.col("target"), tilt)
    again = F.when(words_from(F.col("before") + F.col("source_size")) > 0, place(F.col("before") + F.col("source_size")))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), place(F.col("before")).alias("position"), again.alias("position_again"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of every row, in training order.

    taken is the number of words that the mix takes of the row, repeats counted, at most 2 * size: copies are
    whole but for the last of each source, which is cut where the target is met.  position (0 to 1) is that of
    the first copy.  Rows with a null or empty text have size 0 and take nothing; a null source is a source of
    its own; rows that repeat a doc_id queue each; an empty table gives no rows; further columns are not read.
    """
    return _plan(docs, seed).drop("position_again").orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in training order; its columns are those of ``docs``.

    A document appears once for each copy of which the mix takes at least half; one without words appears
    once, since it costs nothing.  A second copy stands at its own position, that of the words queued before it in
    the second pass over its source.  Rows that share a doc_id share the plan of the one with most words taken.
    """
    docs, names = apart(docs, ("doc_id", "text", "source"))
    plan = _plan(docs, seed).groupBy("doc_id").agg(F.max_by(F.struct("size", "taken", "position", "position_again"), "taken").alias("_m"))
    copies = F.when(F.col("_m.size") == 0, 1).otherwise(F.floor(F.col("_m.taken") / F.col("_m.size") + 0.5)).cast("int")
    out = docs.join(plan.withColumnRenamed("doc_id", "_id").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")))
    out = out.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    at = F.when(F.col("_copy") == 0, F.col("_m.position")).otherwise(F.col("_m.position_again"))
    return together(out.orderBy(at, "doc_id", "_copy").select(*docs.columns), names)
