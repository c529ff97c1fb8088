"""Secrets in texts, told apart by who owns them across the corpus.

A task finds, in the bytes of a batch, assignments of passwords and tokens, access keys and long hexadecimal
runs (the base kinds), and further runs that could be credentials: values without a name before them.
Every value is a candidate under its hash.  Candidates are counted over the corpus by distinct owner, and by
distinct repository of an owner: what many owners or repositories hold is a copied example, what one owner holds
and looks random is live.  Base spans stay whatever their class; of the others those stay that are live and either
look like a key by themselves (opaque) or are the value of a base span elsewhere (reused).

Only candidates are shuffled, by (hash, owner, repository), so a value that a third of all texts hold is spread and
then summed; its class goes back to the texts by a broadcast of the few values that are that frequent.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hot_split, kept
from .wordarrays import byte_slices, joined_bytes

KINDS = ("assign", "access", "hex", "opaque", "reused")
BASE = 3
#: The least length of an assigned value, an access key, a hexadecimal run, a run that may be reused, and one that may be opaque.
ASSIGNED, ACCESS, HEX, BARE, OPAQUE = 8, 16, 32, 12, 20
#: Owners, or repositories of all owners, from which on a value is a copied example.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 50
#: Bits a character from which on a value looks random.
RANDOM = 2.5
#: Bytes of text that are looked at at once; a longer text stands alone.
BATCH_BYTES = 1_000_000
_NAMED = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_STAND_INS = (b"example", b"sample", b"dummy", b"changeme", b"placeholder", b"your", b"xxxx", b"1234567", b"abcdef", b"test")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_DIGITS, _UPPER, _LOWER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_IS_HEX, _IS_BARE = _table(_DIGITS + b"abcdef"), _table(_DIGITS + _UPPER + _LOWER + b"+/_=-")


def looks_random(value: bytes) -> bool:
    """Letters and digits of enough entropy, and no word that stands in for a secret."""
    low = value.lower()
    if not re.search(rb"[0-9]", value) or not re.search(rb"[a-z]", low) or any(s in low for s in _STAND_INS):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= RANDOM


def looks_opaque(value: bytes) -> bool:
    """Long, with capitals, small letters and digits: a key of some service, by its form."""
    return len(value) >= OPAQUE and all(re.search(p, value) for p in (rb"[A-Z]", rb"[a-z]", rb"[0-9]")) and looks_random(value)


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of true of at least this length."""
    edge = np.diff(member.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= least
    return begin[long], end[long]


def spans(buf: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, bytes]]:
    """(text, kind, start, end, value) of every candidate in several texts that stand at ``begins``; start and end are code points of the text.

    A run that may be reused or opaque, told apart later, is of kind 3 and overlaps no base span.
    """
    # the texts one after another, parted by a character that no kind holds
    text = b"\n".join(buf[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True))
    at = begins + np.arange(len(begins))  # of each text in it
    data = np.frombuffer(text, dtype=np.uint8)
    found = [(0, m.start(), m.end(), m.start(1), m.end(1)) for m in _NAMED.finditer(text.lower()) if m.end(1) - m.start(1) >= ASSIGNED]
    found += [(1, m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS]
    found += [(2, a, b, a, b) for a, b in zip(*(x.tolist() for x in _runs(_IS_HEX[data], HEX)), strict=True)]
    begin, end = _runs(_IS_BARE[data], BARE)
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    has = digits[end] > digits[begin] if len(begin) else np.zeros(0, dtype=bool)
    begin, end = begin[has], end[has]
    if found and len(begin):
        cover = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(cover, [f[1] for f in found], 1)
        np.add.at(cover, [f[2] for f in found], -1)
        inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        free = inside[end] == inside[begin]
        begin, end = begin[free], end[free]
    found += [(3, a, b, a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if looks_random(text[a:b])]
    if not found:
        return []
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    kind, start, stop, low, high = np.array(found, dtype=np.int64).T
    row = np.searchsorted(at, start, side="right") - 1
    zero = points[at[row]]
    return [(r, k, s, e, text[a:b]) for r, k, s, e, a, b in zip(row.tolist(), kind.tolist(), (points[start] - zero).tolist(), (points[stop] - zero).tolist(), low.tolist(), high.tolist(), strict=True)]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("random", pa.bool_()), ("opaque", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without their text, numbered, with their candidates."""
    base, n = TaskContext.get().partitionId() << 33, 0
    for b in batches:
        carried = [c for c in b.schema.names if c != "_text"]
        for part in byte_slices(b.column("_text"), BATCH_BYTES):
            rows = b.slice(part.start, part.stop - part.start)
            each: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            for row, kind, start, end, value in spans(*joined_bytes(rows.column("_text"))):
                each[row].append({"kind": kind, "start": start, "end": end, "value": hashlib.blake2b(value, digest_size=16).digest(), "random": looks_random(value), "opaque": looks_opaque(value)})
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(base + n, base + n + rows.num_rows)), *(rows.column(c) for c in carried), pa.array(each, pa.list_(_SPAN))], ["_row", *carried, "_found"])
            n += rows.num_rows


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories, n, named) of every candidate hash of (value, owner, repository, kind): distinct owners, repositories and rows that hold it, and whether a base kind does."""
    pairs = found.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind") < BASE).alias("named"))
    owners = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"), F.max("named").alias("named"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"), F.max("named").alias("named"))


def _joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as KINDS lists them, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_added of every row of ``docs``.

    n_live and n_example count the row's spans by their value's class, n_added those that are no base kind.  A null or empty text
    has no spans: counts of 0, spans empty, base_sha256 that of an empty text.  A null owner or repository is one
    of its own; rows that share a doc_id, and rows without one, are rows of their own; values are
    compared by 128 bits of hash and never returned.  An empty table gives no rows; further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_text"))
    span = "struct<kind: int, start: bigint, end: bigint, value: binary, random: boolean, opaque: boolean>"
    found = kept(rows.mapInArrow(_scan, f"_row long, doc_id long, owner string, repository string, _found array<{span}>"), "secret-candidates")
    each = found.select("_row", "owner", "repository", F.explode("_found").alias("s")).select("_row", "owner", "repository", "s.*")
    values = kept(ownership(each), "secret-owners")
    told = hot_split(each.drop("owner", "repository"), values, "value", "n")
    example = (F.col("owners") >= WIDE_OWNERS) | (F.col("repositories") >= WIDE_REPOSITORIES)
    live = F.col("random") & (F.col("owners") == 1) & ~example
    kind = F.when(F.col("kind") < BASE, F.col("kind")).when(live & F.col("named"), KINDS.index("reused")).when(live & F.col("opaque"), KINDS.index("opaque"))
    told = told.withColumn("kind", kind).where(F.col("kind").isNotNull())
    count = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast("long").alias
    sums = told.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("all"), count(live)("live"), count(example)("example"))
    out = found.select("_row", "doc_id").join(sums, "_row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    n = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("all", lambda s: s["kind"] < BASE)
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        F.coalesce("live", F.lit(0)).alias("n_live"), F.coalesce("example", F.lit(0)).alias("n_example"), (F.size("all") - F.size(base)).cast("long").alias("n_added"),
    )
