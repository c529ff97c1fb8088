"""Audit of how text filters interact, over a sparse document-term matrix.

Texts are cut into shards of some megabytes.  A task turns a shard into rows of compressed sparse form
over the shard's own words; the distinct words of all shards are dealt out by word and numbered, which is
the corpus dictionary, and every shard gets the numbers of its words in the place of its own.  Sums of a row
and the number of its entries are a document's words and distinct words.

Shuffled are the distinct words of every shard, a short row for each document, and sums of documents by
part and set of failed filters: 32 for each part at most, from which all orders of the filters follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checked, kept
from .wordarrays import byte_slices, joined_bytes, words_of

#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 16_000_000
FILTERS = "ABCDE"
LEAST_WORDS = 200
MARKS = b"#$%&*|"


Measure = Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]]


def _compressed(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """The distinct words of texts, and counts of them by text as indptr, indices, data; counted for some texts at a time."""
    owners, words = [], []
    for owner, part in words_of(texts):
        owners.append(owner.astype(np.int32))
        words.append(part)
    told = (pa.concat_arrays(words) if words else pa.array([], pa.binary())).dictionary_encode()
    del words
    size, at, entries, counts, each = max(1, len(told.dictionary)), 0, [], [], np.zeros(len(texts) + 1, dtype=np.int64)
    for owner in owners:
        entry, count = np.unique(owner.astype(np.int64) * size + told.indices[at : at + len(owner)].to_numpy(), return_counts=True)
        at += len(owner)
        row = entry // size
        each[1:] += np.bincount(row, minlength=len(texts))
        entries.append((entry - row * size).astype(np.int32))
        counts.append(count.astype(np.int32))
    joined = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32))
    return told.dictionary, pa.array(np.cumsum(each).astype(np.int32)), joined(entries), joined(counts)


def _local(batches: Iterator[pa.RecordBatch], shard_bytes: int, measure: Measure) -> Iterator[pa.RecordBatch]:
    """A shard a row: what was carried of its documents, and counts of words in compressed sparse form over the words listed."""
    base, n = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        carried = [c for c in b.schema.names if c != "_text"]
        for part in byte_slices(b.column("_text"), shard_bytes):
            rows = b.slice(part.start, part.stop - part.start)
            dictionary, *lists = _compressed(rows.column("_text"))
            column = rows.column("_text")
            told_of = [measure(*joined_bytes(column.slice(p.start, p.stop - p.start))) for p in byte_slices(column)]
            held = {c: rows.column(c) for c in carried} | {c: pa.concat_arrays([t[c] for t in told_of]) for c in told_of[0]}
            columns = {**held, "indptr": lists[0], "indices": lists[1], "data": lists[2], "words": dictionary}
            yield pa.RecordBatch.from_arrays([pa.array([base + n]), *(pa.ListArray.from_arrays([0, len(c)], c) for c in columns.values())], ["shard", *columns])
            n += 1
    pa.default_memory_pool().release_unused()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of word with the partition and the word's number in it; the word itself with its first row only."""
    last, n, here = None, -1, TaskContext.get().partitionId()
    for b in batches:
        word = b.column("word")
        if not len(word):
            continue
        new = np.ones(len(word), dtype=bool)
        new[0] = word[0].as_py() != last
        new[1:] = pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)
        number = n + np.cumsum(new)
        last, n = word[-1].as_py(), int(number[-1])
        yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("_at"), pa.array(np.full(len(word), here, dtype=np.int32)), pa.array(number), pc.if_else(pa.array(new), word, pa.scalar(None, word.type))], ["shard", "_at", "_part", "_number", "word"])


def _same(shard: pa.Table) -> pa.Table:
    return shard


def _global(shard: pa.Table, terms: pa.Table) -> pa.Table:
    """A shard with the dictionary's numbers in the place of its own."""
    of = np.zeros(len(terms), dtype=np.int64)
    of[terms.column("_at").to_numpy()] = terms.column("term").to_numpy()
    own = shard.column("indices").combine_chunks().flatten().to_numpy()
    return shard.set_column(shard.schema.get_field_index("indices"), "indices", pa.array([of[own]], pa.list_(pa.int64())))


def term_matrix(docs: DataFrame, text: str, carried: list[str], shard_bytes: int = SHARD_BYTES, measure: Measure = lambda buf, begins: {}, measured: str = "", then: Callable[[pa.Table], pa.Table] = _same, schema: str = "") -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of ``docs`` and its dictionary (word as binary, term from 0 without gaps).

    The matrix has a row for each shard: shard, lists of the ``carried`` columns of its documents, of what ``measure``
    finds in the bytes of their texts (``measured`` tells the types, as array columns), and indptr, indices, data; entries of document i stand at
    indptr[i]:indptr[i + 1].  With ``then`` each shard is handed on as what it makes of it (``schema``), in the same task.  A null text is empty; every row of ``docs`` is a document; no rows give no shards.
    """
    spark = docs.sparkSession
    raw = docs.select(*carried, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    lists = ", ".join([*(f"{c} array<{docs.schema[c].dataType.simpleString()}>" for c in carried), *([measured] if measured else [])])
    parts = kept(raw.mapInArrow(lambda batches: _local(batches, shard_bytes, measure), f"shard long, {lists}, indptr array<int>, indices array<int>, data array<int>, words array<binary>"), "local-terms", large_rows=True)
    # a word is dealt once for each shard that holds it, so none is more frequent than the share of one shard's words
    dealt = parts.select("shard", F.posexplode("words").alias("_at", "word")).repartition("word").sortWithinPartitions("word")
    told = kept(dealt.mapInArrow(_numbered, "shard long, _at int, _part int, _number long, word binary"), "dictionary")
    sizes = sorted((r["_part"], r["n"]) for r in told.groupBy("_part").agg((F.max("_number") + 1).alias("n")).collect())  # one row for each partition
    offsets = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).tolist()
    starts = spark.createDataFrame([(p, o) for (p, _), o in zip(sizes, offsets, strict=False)], "_part int, _offset long")
    terms = told.join(F.broadcast(starts), "_part").withColumn("term", F.col("_number") + F.col("_offset"))
    each = terms.select("shard", "_at", "term").groupBy("shard")
    schema = schema or f"shard long, {lists}, indptr array<int>, indices array<long>, data array<int>"
    matrix = parts.drop("words").groupBy("shard").cogroup(each).applyInArrow(lambda shard, told: _released(then(_global(shard, told))), schema)
    return matrix, terms.where(F.col("word").isNotNull()).select("word", "term")


def _released(out: pa.Table) -> pa.Table:
    """out, when memory that is free is given back: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    return out


def shard_counts(carried: list[str]) -> Callable[[pa.Table], pa.Table]:
    """What makes of a shard the carried columns, n_words (sum of the row) and n_distinct (entries of the row) of every document in it."""

    def count(shard: pa.Table) -> pa.Table:
        flat = lambda c: shard.column(c).combine_chunks().flatten()
        ends = flat("indptr").to_numpy()
        sums = np.concatenate(([0], np.cumsum(flat("data").to_numpy(), dtype=np.int64)))[ends]
        assert ends[-1] == len(flat("indices"))
        return pa.table({**{c: flat(c) for c in carried}, "n_words": np.diff(sums), "n_distinct": np.diff(ends).astype(np.int64)})

    return count


def _marked(buf: np.ndarray, begins: np.ndarray) -> dict[str, pa.Array]:
    """Bits of the filters C and D that the texts at ``begins`` fail."""
    def count(which: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(which, dtype=np.int32)))[begins])

    is_mark = np.zeros(256, dtype=bool)
    is_mark[list(MARKS)] = True
    capitals, points = count((buf >= 65) & (buf <= 90)), count((buf & 0xC0) != 0x80)
    return {"marked": pa.array(np.where(100 * capitals > 2 * points, 4, 0) + np.where(count(is_mark[buf]) > 0, 8, 0), pa.int32())}


def failures(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part and fails of every row of ``docs``: a bit for each of the filters A to E that its text fails."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    columns = {"doc_id": F.col("doc_id").cast("long"), "part": F.coalesce(F.col(part).cast("string"), F.lit("")), "digest": digest, "text": F.col("text")}
    carried = ["doc_id", "part", "digest"]
    counted = "doc_id long, part string, digest binary, marked int, n_words long, n_distinct long"
    rows, _ = term_matrix(docs.select(*[v.alias(k) for k, v in columns.items()]), "text", carried, measure=_marked, measured="marked array<int>", then=shard_counts([*carried, "marked"]), schema=counted)
    rows = kept(rows, "document-counts")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(copies, "digest", "left")
    short = F.when(F.col("n_words") < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.col("n_distinct") < 50 * F.col("n_words"), 2).otherwise(0)
    return rows.select("doc_id", "part", (short + F.col("marked") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("fails"))


def _orders() -> Column:
    """All orders of the filters, one in a row."""
    return F.explode(F.split(F.lit(" ".join("".join(o) for o in permutations(FILTERS))), " "))


def _bits(letters: Column) -> Column:
    """The filters that these letters name, as bits."""
    return reduce(Column.bitwiseOR, [F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)])


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row for each value of the column ``part``, order of the five filters and step.  A null or empty text has no words
    and no characters, so it fails A and, where a smaller doc_id's text is as empty, E.  Rows that share a
    doc_id are documents of their own and no copies of each other; a null doc_id is no copy, makes none and has no labels; null and
    empty parts are one.  Where labels repeat a doc_id, one row that says good or toxic is enough.  No
    documents give no rows; further columns are not read.
    """
    rows = failures(docs, part)
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    rows = rows.join(checked(said.where(F.col("_good") | F.col("_toxic")), "labels"), "doc_id", "left")
    count = lambda flag: F.sum(F.when(flag, 1).otherwise(0)).alias
    sums = rows.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), count(F.col("_good"))("good"), count(F.col("_toxic"))("toxic"))
    sets = kept(sums.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets")), "failed-sets")  # 32 for a part at most
    steps = sets.select("part", "sets", _orders().alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = steps.withColumns({"own": _bits(F.substring("filter_order", F.col("step"), F.lit(1))), "before": _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    has = lambda x, bits: x["fails"].bitwiseAND(F.col(bits)) != 0

    def total(name, when, what="n"):
        value = lambda x: (what(x) if callable(what) else x[what]).cast("long")
        return F.aggregate("sets", F.lit(0).cast("long"), lambda s, x: s + F.when(when(x), value(x)).otherwise(F.lit(0).cast("long"))).alias(name)

    here = lambda x: has(x, "own") & ~has(x, "before")
    # of the orders of m failed filters, one in m has this filter first
    orders = lambda x: (x["n"] * factorial(len(FILTERS)) / F.greatest(F.lit(1), F.bit_count(x["fails"])))
    return rows.select(
        "part", "filter_order", "step",
        total("kept", lambda x: ~has(x, "own") & ~has(x, "before")), total("removed", here), total("redundant", lambda x: has(x, "own") & has(x, "before")),
        total("unique_fails", lambda x: x["fails"] == F.col("own")), total("good_lost", here, "good"), total("toxic_lost", here, "toxic"), total("shapley", lambda x: has(x, "own"), orders),
    )
