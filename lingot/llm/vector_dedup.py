"""Near-duplicate vectors by an exact metric range join.

Cosine at least t is Euclidean distance at most r = sqrt(2 - 2t) between unit vectors.  Pivots (a
bounded sample) cut each label into cells of vectors nearest to the same pivot.  Two vectors within r
whose nearest pivots differ lie, by the triangle inequality, within r of the plane midway between the
two pivots, which says to which cells a vector is copied; it is copied to lower-numbered cells only,
so each pair meets once.  Cells are joined independently, large ones block against block.

A task returns one row for each vector that has links there: how many, and the least vector that it
reaches within the task.  So the output of a group of n near copies grows with n, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, kept
from .vectors import cosines, hashed_sample, numbers, stack, unit, usable

#: Rows of a pivot's cell at least, most pivots, and rows of a block.
ROWS_A_PIVOT = 500
MOST_PIVOTS = 1_024
BLOCK_ROWS = (256, 4_096)
#: What a row costs that is sent to one more task, in comparisons of two vectors.
ROW_COST = 2_000
#: Rows that are compared with a block at once, and pairs near the threshold that are told exactly at once.
SLICE, EXACT = 512, 100_000


def links(x: np.ndarray, weight: np.ndarray, native: np.ndarray, block: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts, and labels: for each row the first row that it reaches. Rows of one block meet only if there is one block.

    Cosines in single precision decide all pairs but those near the threshold, which double precision decides.
    """
    n, u = len(x), unit(x).astype(np.float32)
    linked = np.zeros((n, n), dtype=bool)
    apart = len(np.unique(block)) > 1
    for at in range(0, n, SLICE):
        s = slice(at, min(at + SLICE, n))
        near = u[s] @ u.T
        hit = near >= threshold
        i, j = np.nonzero(np.abs(near - threshold) < 1e-4)
        for k in range(0, len(i), EXACT):
            a, b = i[k : k + EXACT], j[k : k + EXACT]
            hit[a, b] = cosines(x[s][a], x[b]) >= threshold
        hit &= native[s, None] | native[None, :]
        if apart:
            hit &= block[s, None] != block[None, :]
        linked[s] = hit
    np.fill_diagonal(linked, False)
    some = linked.any(axis=1)
    count = np.zeros(n)
    count[some] = linked[some] @ weight.astype(np.float64)
    label, seen = np.arange(n), ~some
    for first in np.flatnonzero(some):  # breadth first: every row is in one frontier
        frontier = np.array([first])
        if seen[first]:
            continue
        seen[first] = True
        while len(frontier):
            reached = np.zeros(n, dtype=bool)
            for k in range(0, len(frontier), SLICE):
                reached |= linked[frontier[k : k + SLICE]].any(axis=0)
            frontier = np.flatnonzero(reached & ~seen)
            seen[frontier] = True
            label[frontier] = first
    return count.astype(np.int64), label


def crossing(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and to which lower cells it is copied: within r of the plane between the two pivots."""
    square = np.maximum(0, 2 - 2 * x @ pivots.T)
    home = square.argmin(axis=1)
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    excess = square - square[np.arange(len(x)), home][:, None]
    return home, (excess <= 2 * r * between) & (np.arange(len(pivots))[None, :] < home[:, None])


def choose_pivots(x: np.ndarray, r: float, rows: int) -> np.ndarray:
    """Pivots among the unit sample rows x, farthest first, as many as make joining ``rows`` such rows cheapest, two at least.

    Vectors in groups get about one pivot for every ROWS_A_PIVOT rows; directions at random, of which most lie
    near most planes, get few, since their copies would cost more than the cells save.
    """
    most = int(min(MOST_PIVOTS, max(2, rows // ROWS_A_PIVOT), len(x)))
    chosen = [0]
    gap = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    best, least = x[chosen[:2]], np.inf
    p = 2
    while p <= len(chosen):
        home, copy = crossing(x, x[chosen[:p]], r)
        own = np.bincount(home, minlength=p) / len(x) * rows
        copied = copy.mean(axis=0) * rows
        sent = (own + copied) * np.maximum(1, (own + copied) / BLOCK_ROWS[1])
        cost = (own * (own / 2 + copied)).sum() + ROW_COST * sent.sum()
        if cost < least:
            best, least = x[chosen[:p]], cost
        p *= 2
    return best


def near_vectors(vectors: DataFrame, threshold: float = 0.98, seed_rows: int = 4_096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links join vectors of equal label with cosine >= threshold.

    A null label, and a vector that is null, empty, zero or holds null or non-finite components, links with
    nothing, nor do vectors of different dimensions; a null vec_id is kept and unlinked; equal vectors of a
    label are compared once and all link with each other; rows that repeat a vec_id are one node of the
    components; an empty table gives no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), numbers(vectors))
    may_link = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable()
    every = every.withColumn("label", F.when(may_link, F.concat_ws("/", "label", F.size("embedding").cast("string"))))
    good = every.where(F.col("label").isNotNull())
    classes = kept(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    sample = hashed_sample(classes.select("rep", "embedding"), seed_rows, "rep")
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7
    pivots = {int(d): choose_pivots(unit(stack(rows["embedding"])), r, largest) for d, rows in sample.groupby(sample["embedding"].map(len))}
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, rows in b.groupby(b["embedding"].map(len)):
                p = shared.value.get(int(d))
                if p is None:  # a dimension that the sample lacks: one cell
                    yield rows.assign(cell=0, native=True)
                    continue
                home, copy = crossing(unit(stack(rows["embedding"])), p, r)
                yield rows.assign(cell=home, native=True)
                i, j = np.nonzero(copy)
                yield rows.iloc[i].assign(cell=j, native=False)

    cells = kept(classes.mapInPandas(deal, f"label string, embedding {every.schema['embedding'].dataType.simpleString()}, rep long, weight long, cell int, native boolean"), "vector-cells")
    counts = cells.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n")).first()[0] or 1
    block = int(np.clip(mean, *BLOCK_ROWS))
    sized = cells.join(counts.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), ["label", "cell"])
    sized = sized.withColumn("block", F.expr("pmod(xxhash64(rep), blocks)").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sized = sized.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def join_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        native = rows["native"].to_numpy()
        if len(rows) < 2 or not native.any():
            return pd.DataFrame({"rep": [], "hub": [], "links": []})
        rep = rows["rep"].to_numpy()
        n, label = links(stack(rows["embedding"]), rows["weight"].to_numpy(), native, rows["block"].to_numpy(), threshold)
        has = n > 0
        return pd.DataFrame({"rep": rep[has], "hub": rep[label[has]], "links": n[has]})

    found = kept(sized.groupBy("label", "cell", "low", "high").applyInPandas(join_blocks, "rep long, hub long, links long"), "vector-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # a vec_id of several rows ties the classes that these stand in
    again = good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    ties = good.join(again, "vec_id").join(classes.select("label", "embedding", "rep"), ["label", "embedding"]).select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    hubs = components(found.select(F.col("rep").alias("a"), F.col("hub").alias("b")).unionByName(ties))
    known = classes.join(linked, "rep", "left").join(hubs.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = every.join(known, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
