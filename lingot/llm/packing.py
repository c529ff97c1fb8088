"""Best-fit packing of documents into sequences by patterns of few documents.

Token lengths are counted over all pieces: at most ``capacity`` numbers, whatever the corpus.  From
that histogram the driver plans which lengths share a sequence and how often: patterns of two to four
lengths that fill a sequence exactly are enumerated, non-negative least squares fits their repeat
counts to the histogram, the counts are rounded down, and what is left is packed best-fit by
multiplicity.  A piece then finds its sequence from its length and its rank among equal lengths, so
no document ever passes through the driver and no sequence is assembled in one place.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, ranked
from .word_ids import WordIds
from .wordarrays import column_batches

#: Bytes of text whose ids are found at once.
BATCH_BYTES = 400_000

Plan = list[tuple[dict[int, int], int]]


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and an end id, cut where they exceed capacity."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordIds(tokenizer_file)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for part, texts in column_batches(batch.column("text"), BATCH_BYTES):
                for d, ids in zip(doc_ids[part], tokens.ids(texts), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((d, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            d, k, at, n, crc = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_patterns(lengths: list[int], capacity: int, each: int = 5, least: int = 256) -> list[tuple[int, ...]]:
    """Multisets of one to four of the lengths (of at least ``least``) that add up to the capacity; ``each`` per first choice."""
    there = sorted(n for n in lengths if n >= least)
    known = set(there)
    found: set[tuple[int, ...]] = set()
    spread = lambda xs: xs if len(xs) <= each else [xs[i * (len(xs) - 1) // (each - 1)] for i in range(each)]
    for a in there:
        if a == capacity:
            found.add((a,))
        if capacity - a in known:
            found.add(tuple(sorted((a, capacity - a))))
        room = capacity - a
        twos = [b for b in there[: bisect.bisect_right(there, room)] if room - b in known]
        found.update(tuple(sorted((a, b, room - b))) for b in spread(twos))
        for b in spread(there[: bisect.bisect_right(there, room)]):
            threes = [c for c in there[: bisect.bisect_right(there, room - b)] if room - b - c in known]
            found.update(tuple(sorted((a, b, c, room - b - c))) for c in spread(threes)[:2])
    return sorted(found)


def fit_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 12) -> list[float]:
    """Repeat counts x >= 0 of the patterns that minimise the squared distance of their lengths to the histogram, by coordinate descent."""
    left = {n: float(c) for n, c in histogram.items()}
    uses = [[(n, p.count(n)) for n in set(p)] for p in patterns]
    norms = [sum(m * m for _, m in u) for u in uses]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, u in enumerate(uses):
            new = max(0.0, x[i] + sum(m * left[n] for n, m in u) / norms[i])
            if step := new - x[i]:
                x[i] = new
                for n, m in u:
                    left[n] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def plan_sequences(histogram: dict[int, int], capacity: int) -> Plan:
    """Patterns ({length: how many}, repeats) that use up the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: Plan = []

    def use(pattern: dict[int, int], times: int) -> None:
        plan.append((pattern, times))
        for n, m in pattern.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]

    patterns = exact_patterns(list(left), capacity)
    fitted = fit_counts(patterns, left)
    for i in sorted(range(len(patterns)), key=lambda i: -fitted[i]):
        pattern = {n: patterns[i].count(n) for n in set(patterns[i])}
        times = min(int(fitted[i]), *(left.get(n, 0) // m for n, m in pattern.items()))
        if times > 0:
            use(pattern, times)
    # the rest: the longest first, then whatever fits best, as often as the counts allow
    there = sorted(left)
    while there:
        pattern: dict[int, int] = {}
        room = capacity
        while (at := bisect.bisect_right(there, room) - 1) >= 0:
            while at >= 0 and left[there[at]] <= pattern.get(there[at], 0):
                at -= 1
            if at < 0:
                break
            n = there[at]
            more = min(room // n, left[n] - pattern.get(n, 0))
            pattern[n] = pattern.get(n, 0) + more
            room -= n * more
        use(pattern, min(left[n] // m for n, m in pattern.items()))
        there = [n for n in there if n in left]
    return plan


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``.

    A null or empty text is the end id alone; null and repeated doc_ids are rows like any other; equal lengths
    are told apart by a hash of the row; an empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    pieces = kept(token_pieces(docs, tokenizer_file, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    keys, bases, many, offsets = [], [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan_sequences(histogram, capacity):
        offset = 0
        for n in sorted(pattern, reverse=True):
            keys.append((n << 44) + used.get(n, 0))
            bases.append(sequence)
            many.append(pattern[n])
            offsets.append(offset)
            used[n] = used.get(n, 0) + pattern[n] * times
            offset += n * pattern[n]
        sequence += times
    order = np.argsort(np.array(keys, dtype=np.int64))
    slots = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64)[order] for x in (keys, bases, many, offsets)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, base, m, off = slots.value
        for b in batches:
            at = np.searchsorted(key, (b["length"].to_numpy() << 44) + b["rank"].to_numpy(), side="right") - 1
            nth = b["rank"].to_numpy() - (key[at] & ((1 << 44) - 1))
            yield b.drop(columns="rank").assign(sequence_id=base[at] + nth // m[at], offset=off[at] + nth % m[at] * b["length"].to_numpy())

    rows = ranked(pieces, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank")
    return rows.select(*pieces.columns, "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
