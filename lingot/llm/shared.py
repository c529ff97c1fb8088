"""What several operators share: scratch tables, ranks without a global window, and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, known: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> tuple[DataFrame, dict[str, str]]:
    """docs with its further columns under names that no operator uses, and these names' own ones."""
    names = {f"carried_column_{i}": c for i, c in enumerate(docs.columns) if c not in known}
    return docs.select(*[F.col(f"`{c}`").alias(f"carried_column_{i}" if c not in known else c) for i, c in enumerate(docs.columns)]), names


def together(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """docs with the names that ``apart`` took away."""
    return docs.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns])


#: Rows of a small table that may be broadcast; its size is counted first.
BROADCAST_ROWS = 100_000


def checked(small: DataFrame, name: str) -> DataFrame:
    """small, written once, with a broadcast hint only if its rows were counted to be few; else Spark joins it as it finds best."""
    small = kept(small, name)
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def about(df: DataFrame, n: int, *by: str) -> DataFrame:
    """About n rows at most, those of least hash of ``by``: a bound on the hash from the count of rows, nothing is sorted or moved."""
    rows = df.count()
    return df if rows <= n else df.where(F.xxhash64(*by) < F.lit(-(2**63) + int(2**64 * n / rows)))


def least_hashed(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows of least hash of ``by`` (then in its order): a bound on the hash leaves about n before anything is sorted."""
    few = about(df, n + n // 10 + 100, *by)
    if few is not df and few.count() < n:  # a key that very many rows share may take the bound's whole share
        few = df
    return few.orderBy(F.xxhash64(*by), *by).limit(n)


def hot_split(rows: DataFrame, keyed: DataFrame, key: str, count: str, hot: int = 1_000) -> DataFrame:
    """rows joined with ``keyed`` (one written row for each key, ``count`` of rows of the key): keys that hold a thousandth of them all are broadcast.

    There are at most ``hot`` such keys, so their rows stay where they are; the others are shuffled, none of which fills a task.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * hot >= total
    return rows.join(F.broadcast(keyed.where(often).drop(count)), key).unionByName(rows.join(keyed.where(~often).drop(count), key))


def root_buckets(n: Column) -> Column:
    """About sqrt(n) buckets, so that neither a bucket nor the list of buckets grows as n does."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("long")


def ranked(df: DataFrame, group: str, order: list[Column], hash_of: list[Column], rank: str, weight: Column | None = None) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each ``group`` (not null), in the order of a hash and then of ``order``.

    With ``weight``, adds the sum of the weights before the row instead.  A group of n rows is cut into about
    sqrt(n) ranges of the hash; a window runs within a range, and another over the ranges' totals, so a group
    that holds most rows is spread over many tasks.
    """
    at = F.xxhash64(*hash_of)
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    buckets = checked(counts.select(F.col(group).alias("_g"), root_buckets(F.col("_n")).alias("_nb")), "rank-buckets")
    one = F.lit(1).cast("long") if weight is None else weight.cast("long")
    rows = df.withColumn("_h", at).join(buckets, F.col(group) == F.col("_g")).drop("_g")
    rows = rows.withColumn("_b", F.floor((F.shiftrightunsigned("_h", 33) * F.col("_nb")) / F.lit(2**31)).cast("long")).withColumn("_w", one)
    totals = rows.groupBy(group, "_b").agg(F.sum("_w").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.coalesce(before, F.lit(0)).alias("_base"))
    inner = F.sum("_w").over(Window.partitionBy(group, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inner", F.coalesce(inner, F.lit(0)))
    rows = rows.join(totals, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_c")))
    return rows.withColumn(rank, (F.col("_base") + F.col("_inner")).cast("long")).drop("_h", "_nb", "_b", "_w", "_g", "_c", "_base", "_inner")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges(a, b)``; component is the smallest node reached.

    Every round each node moves to the neighbour (or itself) with the least hash and the graph is contracted,
    which leaves a fraction of the nodes; the moves are composed backwards.  A node with very many edges is
    only a key of partially aggregated minima and of joins that Spark can split.  Ties and repeated edges are
    harmless; null ends are ignored.
    """
    spark = edges.sparkSession
    live = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    live = kept(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    for _ in range(most_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a")).toDF("v", "u")
        best = both.groupBy("v").agg(F.min(F.xxhash64("u")).alias("h"))
        best = best.select("v", F.least(F.xxhash64("v"), F.col("h")).alias("h"))
        step = kept(best, "moves")  # h names the new node: xxhash64 of a long is a bijection, so two nodes never share it
        moves.append(step)
        left = live.join(step.select(F.col("v").alias("a"), F.col("h").alias("pa")), "a")
        both_ends = left.join(step.select(F.col("v").alias("b"), F.col("h").alias("pb")), "b")
        live = kept(both_ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not moves:
        return spark.createDataFrame([], "node long, component long")
    root = moves[-1].select(F.col("v"), F.col("h").alias("r"))
    for move in reversed(moves[:-1]):
        root = move.select("v", F.col("h").alias("k")).join(root.select(F.col("v").alias("k"), "r"), "k", "left").select("v", F.coalesce("r", "k").alias("r"))
    root = kept(root, "roots")
    least = root.groupBy("r").agg(F.min("v").alias("component"))
    return root.join(least, "r").select(F.col("v").alias("node"), "component")
