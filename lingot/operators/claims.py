"""First claims: rows of a group in order, of which each takes its names unless an earlier one that was itself let in has taken any of them.

A row that is turned away takes nothing, so whether a row is let in depends on chains of earlier rows.
Rows whose names nobody else has are settled by counts of hashes alone.  Of the others the first ``block`` of each group
are walked in order within one task, which settles every group that has no more.  In larger groups their claims turn
others away, and a round without a walk follows: a row that comes first among the live rows under every one of its names is let in,
and the live rows that share a name with it are turned away.  Both go on in turn until no row is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..plans.scratch import kept

#: Live rows of a group that are walked in one task.
BLOCK = 100_000


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


def _leaders(live: DataFrame, group: str, order: str, names: list[str]) -> DataFrame:
    """live with win: true for those that come first under all their names, else null."""
    rows = live
    for i, c in enumerate(names):
        first = live.groupBy(group, c).agg(F.min(order).alias(f"_first{i}"))
        rows = rows.join(first, [group, c])
    leads = reduce(lambda a, b: a & b, [F.col(order) == F.col(f"_first{i}") for i in range(len(names))])
    return rows.select(*live.columns, F.when(leads, True).alias("win"))


def _walked(live: DataFrame, group: str, order: str, names: list[str], block: int) -> DataFrame:
    """live with win: true or false for about the first ``block`` rows of each group, null for those behind."""
    sizes = live.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_most"))
    several = (sizes.agg(F.max("_n")).first()[0] or 0) > block
    large = sizes.where(F.col("_n") > block).select(group, "_n")
    # the place in order of 1/2, 1/4, ... of a large group's rows, of which the greatest that leaves a block is taken
    halves = F.percentile_approx(order, F.array(*[F.lit(2.0**-k) for k in range(1, 31)]), F.lit(1_000_000))
    cut = live.join(large, group).groupBy(group).agg(halves.alias("_halves"), F.first("_n").alias("_n"))
    cut = cut.select(group, F.element_at("_halves", F.ceil(F.log2(F.col("_n") / block)).cast("int")).alias("_cut"))
    bounds = sizes.join(cut, group, "left").select(group, F.coalesce("_cut", "_most").alias("_bound"))
    rows, columns = live.join(bounds, group) if several else live.withColumn("_bound", F.col(order)), list(live.columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = None
        taken: list[set] = []
        for b in batches:
            win = []
            for key, *row in zip(*(b.column(c).to_pylist() for c in (group, *names)), strict=True):
                if key != last:
                    last, taken = key, [set() for _ in names]
                win.append(not any(x in t for x, t in zip(row, taken, strict=True)))
                if win[-1]:
                    for x, t in zip(row, taken, strict=True):
                        t.add(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(win, pa.bool_())], [*columns, "win"])

    near = rows.where(F.col(order) <= F.col("_bound")).select(*columns).repartition(group).sortWithinPartitions(group, order)
    near = near.mapInArrow(walk, StructType([*live.schema.fields, StructField("win", BooleanType())]))
    return near.unionByName(rows.where(F.col(order) > F.col("_bound")).select(*columns, F.lit(None).cast("boolean").alias("win")))


def turned_away(rows: DataFrame, group: str, order: str, names: list[str], block: int = BLOCK) -> DataFrame:
    """(group, order) of the rows that are turned away; (group, order) tells rows apart, and no column of these is null.

    An empty table turns nobody away; further columns are not read.
    """
    hashes = [f"_hash{i}" for i in range(len(names))]
    slim = live = kept(rows.select(group, order, *[F.xxhash64(c).alias(h) for c, h in zip(names, hashes, strict=True)]), "claimed-hashes")
    for i, h in enumerate(hashes):
        several = slim.groupBy(group, h).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(group, h, F.lit(True).alias(f"_several{i}"))
        live = live.join(several, [group, h], "left")
    # a name that shares its hash alone is let in by the walk
    contested = live.where(_any([F.col(f"_several{i}") for i in range(len(names))])).select(group, order)
    live = kept(rows.select(group, order, *names).join(contested, [group, order], "left_semi"), "contested")
    away = live.limit(0).select(group, order)
    for n in count():
        if live.isEmpty():
            return away
        told = kept(_leaders(live, group, order, names) if n % 2 else _walked(live, group, order, names, block), "claims")
        rest = told.where("win is null").drop("win")
        if rest.isEmpty():
            return away.unionByName(told.where("not win").select(group, order))
        for i, c in enumerate(names):
            rest = rest.join(told.where("win").select(group, c, F.lit(True).alias(f"_taken{i}")), [group, c], "left")
        rest = kept(rest.select(*live.columns, _any([F.col(f"_taken{i}") for i in range(len(names))]).alias("lost")), "claimed")
        away = away.unionByName(told.where("not win").select(group, order)).unionByName(rest.where("lost").select(group, order))
        live = rest.where("not lost").drop("lost")
    return away
