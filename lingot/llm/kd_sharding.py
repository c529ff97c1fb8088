"""Shards of near-equal bytes from a k-d tree over document metadata (DataFrame functions only).

A node that must hold k shards is cut, along the dimension in which it is widest relative to the
whole table, at the weighted quantile that leaves ceil(k/2)/k of its bytes on the left; leaves hold
one shard.  Dimensions are the logarithm of the size and the order-preserving first letters of lang
and source.  Every dimension carries 20 hash bits of the row below its value, so a value that holds
a third of all rows is cut like any other.

A cut is found by zooming: one pass sums bytes in 1,024 bins per node, the next in 1,024 bins of the
bin that holds the quantile, until that bin weighs less than ``slack`` of a shard.  All nodes of a
level share a pass, a pass is one partially aggregated sum, and the driver sees one row per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked, kept, ranked

BINS = 1024
HASH_BITS = 20


def _letters(c: str, n: int) -> Column:
    """The first n bytes of a string as a number that sorts alike; null and empty are 0."""
    padded = F.rpad(F.hex(F.substring(F.encode(F.coalesce(F.col(c), F.lit("")), "utf-8"), 1, n)), 2 * n, "0")
    return F.conv(padded, 16, 10).cast("long")


class _Node:
    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards
        self.dim: str | None = None
        self.cut = 0
        self.left: _Node | None = None
        self.right: _Node | None = None

    def column(self, value) -> Column:
        """value(node) of the leaf that a row falls in."""
        if self.left is None or self.right is None:
            return F.lit(value(self))
        return F.when(F.col(self.dim) < F.lit(self.cut), self.left.column(value)).otherwise(self.right.column(value))

    def leaves(self) -> list[_Node]:
        return [self] if self.left is None or self.right is None else self.left.leaves() + self.right.leaves()


def _split_level(meta: DataFrame, root: _Node, dims: list[str], spread: dict[str, float], slack: float) -> None:
    """Cuts every leaf that still holds several shards."""
    nodes = {n.first: n for n in root.leaves() if n.shards > 1}
    rows = meta.withColumn("_node", root.column(lambda n: n.first)).where(F.col("_node").isin(list(nodes)))
    extent = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    found = {r["_node"]: r for r in rows.groupBy("_node").agg(F.sum("size").alias("bytes"), *extent).collect()}
    search = {}
    for first, node in nodes.items():
        r, half = found.get(first), (node.shards + 1) // 2
        node.left, node.right = _Node(first, half), _Node(first + half, node.shards - half)
        node.dim = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / spread[d]) if r else dims[0]
        if r:
            search[first] = {"lo": r[f"min_{node.dim}"], "hi": r[f"max_{node.dim}"], "goal": r["bytes"] * half / node.shards, "before": 0, "slack": slack * r["bytes"] / node.shards}
    pending = dict(search)
    while pending:
        case = lambda f: F.coalesce(*[F.when(F.col("_node") == k, F.lit(f(s)).cast("long")) for k, s in pending.items()])  # noqa: E731, B023
        key = F.coalesce(*[F.when(F.col("_node") == k, F.col(nodes[k].dim)) for k in pending])
        step = {k: (s["hi"] - s["lo"]) // BINS + 1 for k, s in pending.items()}
        width = F.coalesce(*[F.when(F.col("_node") == k, F.lit(w).cast("long")) for k, w in step.items()])
        near = rows.where(F.col("_node").isin(list(pending))).select("_node", "size", key.alias("_k"), case(lambda s: s["lo"]).alias("_lo"), case(lambda s: s["hi"]).alias("_hi"), width.alias("_w"))
        bins = near.where("_k between _lo and _hi").groupBy("_node", F.expr("(_k - _lo) div _w").alias("_bin")).agg(F.sum("size").alias("_s"))
        total = F.sum("_s").over(Window.partitionBy("_node").orderBy("_bin"))
        goal = F.coalesce(*[F.when(F.col("_node") == k, F.lit(float(s["goal"] - s["before"]))) for k, s in pending.items()])
        crossing = bins.withColumn("_total", total).where(F.col("_total") >= goal).groupBy("_node").agg(F.min_by(F.struct("_bin", "_s", "_total"), "_bin").alias("x"))
        for r in crossing.collect():
            s, x, w = pending[r["_node"]], r["x"], step[r["_node"]]
            s["before"] += x["_total"] - x["_s"]
            s["lo"], s["hi"] = s["lo"] + x["_bin"] * w, s["lo"] + (x["_bin"] + 1) * w - 1
            if w == 1 or x["_s"] <= s["slack"]:
                after = s["goal"] - s["before"] > x["_s"] / 2  # the nearer end of the bin
                nodes[r["_node"]].cut = s["hi"] + 1 if after else s["lo"]
                del pending[r["_node"]]


def _equal_rows_numbered(meta: DataFrame) -> DataFrame:
    """Adds _nth: 0, 1, ... among rows that are equal in all columns, which is which being all the same."""
    meta = kept(meta.withColumn("_same", F.xxhash64(*meta.columns)).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    often = checked(meta.groupBy("_same").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select("_same"), "equal-rows")
    single = meta.join(often, "_same", "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    return single.unionByName(ranked(meta.join(often, "_same"), "_same", [F.col("_row")], [F.col("_row")], "_nth")).drop("_same", "_row")


def kd_shards(docs: DataFrame, n_shards: int = 24, slack: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    size is the UTF-8 length of the text plus 8; law is ``bytes``: sizes of shards differ by about ``slack``
    of a shard and one document; slot numbers the rows of a shard from 0.  A null text counts as empty, null
    lang and source as the least value; null and repeated doc_ids are kept as rows like any other; ties on all
    dimensions are cut by hash bits, in which equal rows are numbered; an empty table gives no rows; further columns are not read.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    meta = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _letters("lang", 3).alias("_lang"), _letters("source", 5).alias("_source"))
    tie = F.expr(f"xxhash64(doc_id, text_crc32, _nth) & {2**HASH_BITS - 1}")
    dims = {"d_size": F.floor(F.log2("size") * 4096), "d_lang": F.col("_lang"), "d_source": F.col("_source")}
    meta = _equal_rows_numbered(meta)
    meta = kept(meta.select("doc_id", "size", "text_crc32", *[(v.cast("long") * 2**HASH_BITS + tie).alias(d) for d, v in dims.items()]), "shard-meta")
    whole = meta.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    root = _Node(0, n_shards)
    if whole["d_size"] is not None:
        while any(n.shards > 1 for n in root.leaves()):
            _split_level(meta, root, list(dims), {d: max(1, whole[d]) for d in dims}, slack)
    sharded = meta.select("doc_id", "size", "text_crc32", root.column(lambda n: n.first).cast("int").alias("shard"))
    placed = ranked(sharded, "shard", [F.col("doc_id"), F.col("text_crc32")], [F.col("doc_id"), F.col("text_crc32")], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
