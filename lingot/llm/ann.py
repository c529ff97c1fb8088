"""Approximate nearest neighbours by adaptive dimension scanning within inverted lists.

Vectors are dealt to the lists of a coarse k-means (fitted on a bounded sample).  A query visits the
lists nearest to it; how many is fitted on the sample so that its own neighbours are found there.
Within a list the vectors are rotated by a fixed random orthogonal matrix and read in blocks of
columns: after each block, a distance estimated from the dimensions so far that a hypothesis test
puts above the query's bound abandons the candidate.  Survivors get their exact cosine in double
precision on the original vectors.  The sample only shapes the index: every row is in a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept
from .vectors import cosines, hashed_sample, numbers, stack, unit, usable

#: Bounds of the index: rows of the sample, lists, rows of a list that one task scans.
SAMPLE_ROWS = 20_000
MOST_LISTS = 2_500
BLOCK_ROWS = (256, 4_096)
#: Pairs of a query and a candidate that are scanned at once.
PAIRS = 500_000
#: Columns of a block, and the significance of the test (standard deviations).
COLUMNS = 16
EPSILON = 2.1
#: Sample rows, or a fifth of a small sample, that the lists are not fitted on.
HELD_OUT = 400


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means on unit rows."""
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(axis=1))
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1e-30)[:, None], centre)
    return centre


def fit_probes(q: np.ndarray, x: np.ndarray, centre: np.ndarray, k: int, recall: float) -> int:
    """How many lists hold ``recall`` of the k rows of x nearest to rows q, which neither x nor the fit of the lists holds."""
    top = np.argsort(-(q @ x.T), axis=1)[:, :k]
    home = np.argmax(x @ centre.T, axis=1)
    order = np.argsort(np.argsort(-(q @ centre.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(order, home[top], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1


def scan(q: np.ndarray, bound: np.ndarray, x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the adaptive scan doesn't abandon; bound: largest squared distance of unit vectors wanted."""
    d = x.shape[1]
    qr, xr = unit(q) @ turn, unit(x) @ turn
    first = slice(0, min(COLUMNS, d))
    partial = (qr[:, first] ** 2).sum(1)[:, None] + (xr[:, first] ** 2).sum(1)[None, :] - 2 * qr[:, first] @ xr[:, first].T
    at = first.stop
    limit = bound * (1 + EPSILON / np.sqrt(at)) ** 2 * (at / d) if at < d else bound + 1e-9
    i, j = np.nonzero(partial <= limit[:, None] + 1e-9)
    got = partial[i, j]
    while at < d and len(i):
        cols = slice(at, min(at + COLUMNS, d))
        got = got + ((qr[i, cols] - xr[j, cols]) ** 2).sum(axis=1)
        at = cols.stop
        limit = bound[i] * ((1 + EPSILON / np.sqrt(at)) ** 2 * (at / d) if at < d else 1.0) + 1e-9
        go = got <= limit
        i, j, got = i[go], j[go], got[go]
    return i, j


def scanned(q: np.ndarray, bound: np.ndarray, x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``scan`` for a few queries at a time, so that its memory doesn't grow with the cell."""
    step = max(1, PAIRS // max(1, len(x)))
    got = [scan(q[k : k + step], bound[k : k + step], x, turn) for k in range(0, len(q), step)]
    return np.concatenate([i + k * step for k, (i, _) in enumerate(got)]), np.concatenate([j for _, j in got])


def nearest(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query i: by score, ties to the smaller id."""
    order = np.lexsort((ids, -score, i))
    i = i[order]
    start = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.zeros(0, dtype=bool)
    nth = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0))
    return order[nth < k]


def search(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine found for each query, itself excluded.

    Vectors that are null, empty, zero or hold null or non-finite components, or whose dimension is not that
    of most sampled rows, take no part, neither do null vec_ids; equal vectors tie to the smaller vec_id; rows
    that repeat a vec_id count as that one neighbour, and the least of their vectors asks; with fewer candidates than k all are returned; an empty table gives no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers(vectors), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable())
    sample = hashed_sample(rows.select("vec_id", "embedding"), sample_rows, "vec_id")
    if not len(sample):
        return spark.createDataFrame([], schema)
    d = int(sample["embedding"].map(len).mode()[0])
    sample = sample[sample["embedding"].map(len) == d].drop_duplicates("vec_id")
    rows = rows.where(F.size("embedding") == d)
    total = rows.count()
    x = stack(sample["embedding"])
    xu, sample_ids = unit(x), sample["vec_id"].to_numpy()
    # the sample is in hashed order: its first rows are held out and tell how many lists a query that the fit never saw must visit
    out = min(HELD_OUT, len(x) // 5)
    lists = max(1, min(MOST_LISTS, int(np.sqrt(total)), len(x) // 8))
    centre = fit_centroids(xu[out:], lists)
    probes = fit_probes(xu[:out], xu[out:], centre, k, recall)
    shared = spark.sparkContext.broadcast((centre, rotation(d), x, sample_ids))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(list=np.argmax(unit(stack(b["embedding"])) @ shared.value[0].T, axis=1))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds the lists that each query visits, and the bound from which it searches: the cosine of the 2k-th of the sample rows in these lists.

        These rows stand in lists that it visits, so k answers are left though the test abandons some by chance.  Where there
        are too few, nothing is abandoned.
        """
        centre, _, x, ids = shared.value
        home = np.argmax(unit(x) @ centre.T, axis=1)
        held = np.bincount(home, minlength=len(centre))
        for b in batches:
            for part in np.array_split(np.arange(len(b)), max(1, len(b) // 256)):
                q, qid = stack(b["embedding"].iloc[part]), b["vec_id"].iloc[part].to_numpy()
                near = unit(q) @ unit(x).T
                order = np.argsort(-(unit(q) @ centre.T), axis=1)
                place = np.argsort(order, axis=1)
                # enough lists that they hold twice k rows of the sample besides the query itself
                enough = (np.cumsum(held[order], axis=1) < 2 * k + 1).sum(axis=1) + 1
                seen = np.minimum(np.maximum(probes, enough), len(centre))
                near[(qid[:, None] == ids[None, :]) | (place[:, home] >= seen[:, None])] = -2
                best = -np.sort(-near, axis=1)
                floor = np.where(best[:, 2 * k - 1] > -2, best[:, 2 * k - 1], -np.inf) if best.shape[1] >= 2 * k else np.full(len(q), -np.inf)
                order = [o[:n] for o, n in zip(order, seen, strict=True)]
                yield pd.DataFrame({"query_id": qid, "embedding": list(q), "floor": floor, "lists": order})

    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = kept(rows.select("vec_id", "embedding").mapInPandas(deal, f"vec_id long, embedding {kind}, list int"), "ann-lists")
    asked = kept(rows.where("is_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInPandas(probe, f"query_id long, embedding {kind}, floor double, lists array<int>"), "ann-queries")
    block = int(np.clip(2 * total // lists, *BLOCK_ROWS))
    visits = asked.select("query_id", "embedding", "floor", F.explode("lists").alias("list"))
    parts = lambda n: F.ceil(n / block).cast("int")
    # one row per list, at most MOST_LISTS
    held = dealt.groupBy("list").agg(parts(F.count(F.lit(1))).alias("blocks"))
    wanted = visits.groupBy("list").agg(parts(F.count(F.lit(1))).alias("turns"))
    sizes = F.broadcast(held.join(wanted, "list"))
    ahead = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.join(sizes, "list").withColumn("block", F.expr("pmod(xxhash64(vec_id), blocks)").cast("int")).withColumn("turn", ahead("turns"))
    right = visits.join(sizes, "list").withColumn("turn", F.expr("pmod(xxhash64(query_id), turns)").cast("int")).withColumn("block", ahead("blocks"))
    cell = ["list", "block", "turn"]

    def visit(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, y, ids, qid = stack(c["embedding"]), stack(q["embedding"]), c["vec_id"].to_numpy(), q["query_id"].to_numpy()
        i, j = scanned(y, 2 - 2 * q["floor"].to_numpy(), x, shared.value[1])
        other = qid[i] != ids[j]
        i, j = i[other], j[other]
        score = np.concatenate([cosines(y[i[k : k + PAIRS]], x[j[k : k + PAIRS]]) for k in range(0, max(1, len(i)), PAIRS)])
        best = nearest(i, ids[j], score, k)
        return pd.DataFrame({"query_id": qid[i[best]], "vec_id": ids[j[best]], "score": score[best]})

    found = left.select(*cell, "vec_id", "embedding").groupBy(*cell).cogroup(right.select(*cell, "query_id", "embedding", "floor").groupBy(*cell)).applyInPandas(visit, "query_id long, vec_id long, score double")
    every = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
