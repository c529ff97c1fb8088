"""Near-duplicate documents by weighted Jaccard similarity of their shingle multisets, with BagMinHash signatures.

A shingle that occurs c times has weight c.  Weights are discretised into the dyadic intervals [0, 1),
[1, 2), [2, 4), ...; each (shingle, interval) owns a Poisson process whose points carry a time, one of
the signature's slots and a unit cell of the interval.  A document sees the points whose cell lies
below its weight, and a slot keeps the earliest: two documents agree in a slot with probability equal
to their weighted Jaccard similarity.  Only points earlier than the time by which all slots are filled
are ever drawn, so a signature costs about m log m points and not m for every shingle.

Signatures are banded; documents that share a band are candidates, candidate groups are compared block
against block, and every link rests on the exact overlap of the two multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, kept
from .wordarrays import Words, mix, text_batches

SHINGLE = 5
BANDS, BAND_SLOTS = 40, 6
#: Bytes of text whose points are drawn at once.
BATCH_BYTES = 500_000
SLOTS = BANDS * BAND_SLOTS
#: Documents of a block; candidate groups beyond it are compared block against block.
BLOCK_ROWS = 128
#: Share of equal signature bytes under which a pair of similarity >= 0.8 practically never falls (over five deviations).
LEAST_AGREEMENT = 0.66
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multisets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted; a text of fewer than k words has one shingle of all of them."""
    h, at = words.runs(k)
    owner = words.owner()[at] if len(at) else at
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        begin = words.first[short]
        h = np.concatenate((h, mix(words.span_sums(begin, begin + n[short]) + n[short].astype(np.uint64))))
        owner = np.concatenate((owner, short))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(new)
    return owner[begin], h[begin], np.diff(np.append(begin, len(h)))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, m: int = SLOTS) -> np.ndarray:
    """texts x m array of 64-bit marks; rows of texts without shingles are 0."""
    out = np.zeros((texts, m), dtype=np.uint64)
    todo = np.unique(owner)
    total = np.bincount(owner, weights=count, minlength=texts)
    reach = np.log(m) + 3.0
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < texts else np.ones(len(owner), dtype=bool)
        times = np.full(texts * m, np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        o, s, c = owner[mine], shingle[mine], count[mine]
        level = 0
        while len(o):
            low, size = (0, 1) if level == 0 else (2 ** (level - 1), 2 ** (level - 1))
            key = mix(s ^ mix(np.full(1, level + 1, dtype=np.uint64)))
            for at, t, mark in _points(o, key, c, low, size, reach / total[o], m):
                np.minimum.at(times, at, t)
                found.append((at, t, mark))
            level += 1
            more = c > low + size
            o, s, c = o[more], s[more], c[more]
        flat = out.reshape(-1)
        for at, t, mark in found:
            won = times[at] == t
            flat[at[won]] = mark[won]
        todo = todo[np.isinf(times.reshape(texts, m)[todo]).any(axis=1)]
        reach *= 1.7
    return out


def _points(owner: np.ndarray, key: np.ndarray, count: np.ndarray, low: int, size: int, until: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slot of text, time, mark) of the points of an interval's processes before ``until`` and below the weights."""
    rate = float(m * size)
    begun, drawn = np.zeros(len(key)), np.zeros(len(key), dtype=np.int64)
    while len(key):
        mean = (until - begun) * rate
        n = np.where(drawn == 0, np.ceil(mean + np.sqrt(mean)), np.ceil(mean) + 1).astype(np.int64)
        n = np.maximum(n, 1)
        item = np.repeat(np.arange(len(key)), n)
        first = np.cumsum(n) - n
        nth = drawn[item] + np.arange(len(item)) - first[item]
        mark = mix(key[item] + (nth + 1).astype(np.uint64) * _STEP)
        gap = -np.log(((mark >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        run = np.cumsum(gap)
        t = run - (run[first] - gap[first])[item] + begun[item]
        dice = mix(mark ^ _STEP)
        cell = low + ((dice >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        ok = (t < until[item]) & (cell < count[item])
        yield owner[item[ok]] * m + ((dice & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)[ok], t[ok], mark[ok]
        last = first + n - 1
        more = t[last] < until
        begun, drawn = t[last][more], (drawn + n)[more]
        owner, key, count, until = owner[more], key[more], count[more], until[more]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = sig.reshape(len(sig), BANDS, BAND_SLOTS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (len(sig), BANDS)).copy()
    for i in range(BAND_SLOTS):
        key = mix(key ^ parts[:, :, i])
    return key.view(np.int64)


def signature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for part in text_batches(b["text"].tolist(), BATCH_BYTES):
            w = Words(b["text"].iloc[part].tolist())
            n = np.diff(w.first)
            begin = w.first[:-1]
            whole = w.span_sums(begin, begin + n) + n.astype(np.uint64)
            owner, h, c = multisets(w)
            sig = signatures(owner, h, c, len(n))
            some = n > 0
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].iloc[part].to_numpy()[some],
                    "c1": mix(whole)[some].view(np.int64),
                    "c2": mix(np.bitwise_xor.reduceat(np.append(mix(w.hashes + _STEP), np.uint64(0)), begin)[some] + whole[some]).view(np.int64),
                    "bands": list(band_keys(sig[some])),
                    "sig": [r.tobytes() for r in (sig[some] & np.uint64(0xFF)).astype(np.uint8)],
                }
            )


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return both / (a[1].sum() + b[1].sum() - both)


def _linked(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(rep, hub): for each document with a link in this block or between these two, the least one that it reaches."""
    rows = rows.sort_values("rep", ignore_index=True)
    n = len(rows)
    sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(n, -1)
    sets = [(np.asarray(h, dtype=np.int64), np.asarray(c, dtype=np.int64)) for h, c in zip(rows["hashes"], rows["counts"], strict=True)]
    total = np.array([c.sum() for _, c in sets])
    block = rows["block"].to_numpy()
    two = len(np.unique(block)) > 1
    label = np.arange(n)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[np.minimum(total[j], total[i]) >= threshold * np.maximum(total[j], total[i])]
        if two:
            j = j[block[j] != block[i]]
        j = j[(sig[j] == sig[i]).mean(axis=1) >= LEAST_AGREEMENT]
        for k in j:
            if label[k] != label[i] and overlap(sets[i], sets[k]) >= threshold:
                low, high = sorted((label[i], label[k]))
                label[label == high] = low
    moved = label != np.arange(n)
    rep = rows["rep"].to_numpy()
    return pd.DataFrame({"a": rep[moved], "b": rep[label[moved]]})


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, component_id, kept of every row: documents linked by weighted Jaccard similarity >= threshold of 5-word shingles.

    component_id is the smallest doc_id reached by links, kept says that it is the row's own.  Texts without
    words, null ones included, and null doc_ids link with nothing; a text of fewer than five words links with
    texts of the same words only; rows that repeat a doc_id are one node; an empty table gives no rows; further
    columns are not read.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = text.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    signed = kept(some.mapInPandas(signature_rows, "doc_id long, c1 long, c2 long, bands array<long>, sig binary"), "signatures")
    reps = kept(signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "copies")
    alone = signed.join(reps, ["c1", "c2"]).where("doc_id = rep").select("rep", "sig", "bands").dropDuplicates(["rep"])
    keys = alone.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = keys.join(shared, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    groups = kept(components(stars), "candidates")
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    cand = groups.join(sizes, "component").withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
    cand = cand.join(signed.select(F.col("doc_id").alias("node"), "sig").dropDuplicates(["node"]), "node")
    # the candidates are far smaller than the texts, so they are the side that is hashed; texts are not sorted
    bodies = some.join(cand.withColumnRenamed("node", "doc_id").hint("shuffle_hash"), "doc_id")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in text_batches(b["text"].tolist(), BATCH_BYTES):
                rows = b.iloc[part]
                owner, h, c = multisets(Words(rows["text"].tolist()))
                cut = np.searchsorted(owner, np.arange(1, len(rows)))
                # sorted as signed numbers, as they are read back
                both = [(lambda s: (a[s], n[s].astype(np.int32)))(np.argsort(a)) for a, n in zip(np.split(h.view(np.int64), cut), np.split(c, cut), strict=True)]
                yield pd.DataFrame({"rep": rows["doc_id"].to_numpy(), "component": rows["component"].to_numpy(), "block": rows["block"].to_numpy(), "blocks": rows["blocks"].to_numpy(), "sig": rows["sig"].to_numpy(), "hashes": [x[0] for x in both], "counts": [x[1] for x in both]})

    sets = bodies.mapInPandas(shingled, "rep long, component long, block int, blocks int, sig binary, hashes array<long>, counts array<int>")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    linked = kept(sets.groupBy("component", "low", "high").applyInPandas(lambda p: _linked(p, threshold), "a long, b long"), "links")
    found = components(linked)
    member = signed.join(reps, ["c1", "c2"]).select("doc_id", "rep").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    placed = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id").alias("_d"), F.coalesce("component", "rep").alias("_c"))
    out = text.select("doc_id").join(placed, F.col("doc_id") == F.col("_d"), "left")
    return out.select("doc_id", F.coalesce("_c", "doc_id").alias("component_id"), F.coalesce(F.coalesce("_c", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
