"""Removal of passages that repeat across or within documents: seed and extend.

Seeds are winnowed anchors: of the k-grams in every window of ``span`` words the one of least hash, so
two equal windows always have the same anchor at the same place.  Anchors that occur in one document
only are dropped.  Around each anchor that several documents hold, the match is extended both ways as
far as the windows that chose this anchor reach, as hashes of whole windows; a window whose hash an
earlier document also holds is repeated.  Windows that repeat within a document are found there.  The
union of a document's repeated windows are its maximal repeats, and their words go.

A window's hash has 96 bits: 64 to find it and 32 to check it, from two independent sums over two independent hashes of its words.

Shuffled are one number for each anchor (about one in eight words), one for each window of a repeated
anchor, and the texts once: Spark reuses their exchange in the joins that need them.  Frequent
passages are minima, which are aggregated before the shuffle, and join keys, which Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, checked, hot_split, kept, together
from .wordarrays import Words, column_batches, mix

SPAN, GRAM = 20, 6


def anchors(w: Words, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``span`` words: its first word, its anchor's first word, and the anchor's hash."""
    n = len(w)
    none = np.zeros(0, dtype=np.int64)
    if n < span:
        return none, none, none.astype(np.uint64)
    begin = np.arange(n - k + 1)
    value, place = mix(w.span_sums(begin, begin + k)), begin
    gram = value
    length, most = 1, span - k + 1
    while length < most:  # leftmost least of ever longer stretches
        step = min(length, most - length)
        right = value[step:] < value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        length += step
    owner = w.owner()
    start = np.flatnonzero(owner[: n - span + 1] == owner[span - 1 :])
    return start, place[start], gram[place[start]]


def _in_text(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for (text of the batch, hash)."""
    return key ^ mix(text.astype(np.uint64) + np.uint64(1))


def _hashes(w: Words, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window that starts there: 64 bits, and 32 more from another sum."""
    return mix(w.span_sums(start, start + SPAN)), (mix(w.span_sums(start, start + SPAN, second=True)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _flat(column: pa.Array, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row (from 0) of each; null lists are empty."""
    part = column.slice(rows.start, rows.stop - rows.start)
    sizes = np.array([len(x) if x is not None else 0 for x in part.to_numpy(zero_copy_only=False)], dtype=np.int64)
    return part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc_id): every anchor once for each document."""
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        for part, texts in column_batches(b.column("text")):
            w = Words(texts)
            start, place, h = anchors(w)
            owner = w.owner()[start]
            new = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, dtype=bool)
            h, owner = h[new], owner[new]
            _, once = np.unique(_in_text(owner, h), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(ids[part][owner[once]])], ["h", "doc_id"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, check, doc_id, asks): hashes of the windows whose anchor is listed; asks where an earlier document holds the anchor."""
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        for part, texts in column_batches(b.column("text")):
            w = Words(texts)
            start, _, h = anchors(w)
            owner = w.owner()[start]
            listed, row = _flat(b.column("_hs"), part)
            first, _ = _flat(b.column("_firsts"), part)
            keys = _in_text(row, listed.astype(np.int64).view(np.uint64))
            order = np.argsort(keys)
            keys, first = keys[order], first[order].astype(bool)
            mine = _in_text(owner, h)
            at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
            hit = keys[at] == mine if len(keys) else np.zeros(len(mine), dtype=bool)
            start, owner, asks = start[hit], owner[hit], ~first[at[hit]] if len(keys) else np.zeros(0, dtype=bool)
            window, check = _hashes(w, start)
            _, once = np.unique(_in_text(owner, window), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(window[once].view(np.int64)), pa.array(check[once]), pa.array(ids[part][owner[once]]), pa.array(asks[once])], ["window", "check", "doc_id", "asks"])


def _keep(texts: list[str | None], repeated: np.ndarray, checks: np.ndarray, row: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words, removed words and kept text of each text; repeated, checks: hashes of windows of text ``row`` that an earlier document holds."""
    w = Words(texts)
    n = np.diff(w.first)
    owner = w.owner()
    start = np.flatnonzero(owner[: max(0, len(w) - SPAN + 1)] == owner[SPAN - 1 :]) if len(w) >= SPAN else np.zeros(0, dtype=np.int64)
    window, check = _hashes(w, start)
    key = _in_text(owner[start], window)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(start), dtype=bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (check[order[1:]] == check[order[:-1]])  # a later start of the same window in the same text
    gone = again | copy[owner[start]]
    if len(repeated):
        there = _in_text(row, repeated.astype(np.int64).view(np.uint64))
        sort = np.argsort(there)
        there, checks = there[sort], checks[sort]
        at = np.minimum(np.searchsorted(there, key), len(there) - 1)
        gone |= (there[at] == key) & (checks[at] == check)
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(edge, start[gone], 1)
    np.add.at(edge, start[gone] + SPAN, -1)
    stays = np.cumsum(edge)[:-1] == 0
    removed = np.bincount(owner[~stays], minlength=len(texts))
    buf = np.frombuffer(w.data, dtype=np.uint8).copy()
    buf[w.ends] = 32
    depth = np.zeros(len(buf) + 1, dtype=np.int8)
    depth[w.starts[stays]] += 1
    depth[w.ends[stays] + 1] -= 1
    out = buf[np.cumsum(depth[:-1], dtype=np.int8) > 0].tobytes()
    size = np.bincount(owner[stays], weights=(w.ends - w.starts + 1)[stays], minlength=len(texts)).astype(np.int64)
    end = np.cumsum(size)
    return n, removed, [out[e - s : max(e - 1, e - s)].decode("utf-8", "surrogatepass") for s, e in zip(size, end, strict=True)]


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        copy = b.column("_is_copy").to_numpy(zero_copy_only=False).astype(bool)
        carried = [c for c in b.schema.names if c not in ("_repeated", "_checks", "_is_copy")]
        for part, texts in column_batches(b.column("text")):
            repeated, row = _flat(b.column("_repeated"), part)
            n, removed, left = _keep(texts, repeated, _flat(b.column("_checks"), part)[0], row, copy[part])
            rows = b.slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in carried], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())], [*carried, "_n_words", "_n_removed", "_kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with _n_words, _n_removed and _kept (the kept words, joined by one space).

    A word goes if a window of 20 words that covers it also starts earlier: in a document of smaller doc_id, or
    in the same one.  Null and empty texts have no words, and texts of fewer than 20 words lose none.  Rows that
    share a doc_id are compared with other documents, not with each other, whether their texts are equal or not;
    rows without a doc_id only with themselves.  An empty table gives no rows; further columns are carried along, those of
    the names of the three new ones as carried_column_<place>.
    """
    docs, names = apart(docs, ("doc_id", "text"))
    # without a needless cast all joins of the texts read one and the same exchange
    texts = docs if docs.schema["doc_id"].dataType.simpleString() == "bigint" else docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    named = texts.where(F.col("doc_id").isNotNull())
    body = named.select("doc_id", "text")
    # later copies of a whole text lose every window; only its first holder is looked at further
    digest = body.where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("digest"), F.xxhash64("text").alias("mark"))
    first = kept(digest.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "texts")
    # a doc_id that several texts share is no copy of any of them: its windows tell
    shared = checked(digest.groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").select("doc_id"), "shared-ids")
    single = digest.select("doc_id", "digest").join(shared, "doc_id", "left_anti")
    copies = checked(hot_split(single, first, "digest", "n").where("doc_id > rep").select("doc_id").distinct(), "copies")
    seen = body.join(copies, "doc_id", "left_anti").mapInArrow(_occurrences, "h long, doc_id long")
    # counts of rows: what repeats only in rows of one doc_id falls away where earlier documents are asked for
    several = seen.groupBy("h").agg(F.min("doc_id").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "earliest")
    several = kept(several, "anchors")
    listed = seen.join(several.hint("shuffle_hash"), "h").groupBy("doc_id").agg(F.collect_list("h").alias("_hs"), F.collect_list(F.col("doc_id") == F.col("earliest")).alias("_firsts"))
    listed = kept(listed, "anchor-lists")
    windows = named.join(listed.hint("shuffle_hash"), "doc_id").mapInArrow(_windows, "window long, check int, doc_id long, asks boolean")
    holders = windows.groupBy("window", "check").agg(F.min("doc_id").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "check", "earliest")
    repeated = windows.where("asks").join(holders.hint("shuffle_hash"), ["window", "check"]).where("doc_id > earliest")
    repeated = repeated.groupBy("doc_id").agg(F.collect_list(F.struct("window", "check")).alias("r")).select("doc_id", F.col("r.window").alias("_repeated"), F.col("r.check").alias("_checks"))
    marked = named.join(repeated.hint("shuffle_hash"), "doc_id", "left").join(copies.withColumn("_is_copy", F.lit(True)), "doc_id", "left")
    marked = marked.select(*texts.columns, "_repeated", "_checks", F.coalesce("_is_copy", F.lit(False)).alias("_is_copy"))
    lone = texts.where(F.col("doc_id").isNull()).select(*texts.columns, F.lit(None).cast("array<long>").alias("_repeated"), F.lit(None).cast("array<int>").alias("_checks"), F.lit(False).alias("_is_copy"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), "_n_words long, _n_removed long, _kept string"])
    found = marked.unionByName(lone).mapInArrow(_kept_texts, schema)
    clashing = {c for c in names.values() if c.lower() in ("_n_words", "_n_removed", "_kept")}
    return together(found, {k: c for k, c in names.items() if c not in clashing})
