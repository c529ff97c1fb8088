"""Reachability over reference graphs of many archives at once."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import any_in
from ..plans.scratch import kept, scratch_dir


def reference_edges(entries: DataFrame) -> DataFrame:
    """(archive_id, src, dst): a class refers to another of its archive whose slashed name its content holds.

    Names are taken out of the content as tokens.  A name is a substring of a token that starts at one of its parts: its folders
    are parts of the token in full, its last part begins the next one.  So folders are joined first, and only for folders of the
    archive is the next part cut to the lengths that names there have.
    """
    classes = entries.select("archive_id", F.regexp_replace("source", r"\.class$", "").alias("name"), "content").where(F.col("source").endswith(".class"))
    names = classes.select("archive_id", F.col("name").alias("dst")).where(F.col("dst").contains("/")).distinct()
    last = F.element_at(F.split("dst", "/"), -1)
    folders = names.groupBy("archive_id", F.regexp_extract("dst", r"(?s)^(.*)/", 1).alias("folder")).agg(F.collect_set(F.char_length(last)).alias("lengths"))
    tokens = classes.select("archive_id", F.col("name").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\w$]+(?:/[\w$]+)+"), F.lit(0)))).alias("token"))
    parts = F.split("token", "/")
    ends = F.sequence(F.lit(2), F.size(parts))
    spans = F.flatten(F.transform(ends, lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: F.struct(F.array_join(F.slice(parts, i, j - i), "/").alias("folder"), F.get(parts, j - 1).alias("next")))))
    inside = tokens.select("archive_id", "src", F.inline(F.array_distinct(spans))).distinct().join(folders, ["archive_id", "folder"])
    cut = inside.select("archive_id", "src", "folder", "next", F.explode("lengths").alias("n")).where(F.col("n") <= F.char_length("next"))
    found = cut.select("archive_id", "src", F.concat_ws("/", "folder", F.substr("next", F.lit(1), F.col("n"))).alias("dst")).where("src <> dst").distinct()
    return found.join(names, ["archive_id", "dst"]).select("archive_id", "src", "dst")


def shortest_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(archive_id, root, node, hops, path): a shortest path from every root(archive_id, root) to every node it reaches.

    Level by level over all archives at once, until a level is empty: the frontier joins the edges, nodes seen before go,
    and of several paths to a node the least stays.  Levels are parts of one table in the shared folder.
    """
    spark = edges.sparkSession
    path = f"{scratch_dir(spark)}/levels-{uuid.uuid4().hex}"
    edges = kept(edges.select("archive_id", F.col("src").alias("node"), "dst"), "edges")
    new = roots.distinct().select("archive_id", "root", F.col("root").alias("node"), F.lit(0).alias("hops"), F.array("root").alias("path"))
    schema, level = new.schema, 0
    while True:
        at = f"{path}/level={level}"
        new.write.parquet(at)
        frontier = spark.read.schema(schema).parquet(at)
        if frontier.isEmpty():
            break
        level += 1
        seen = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
        step = frontier.join(edges, ["archive_id", "node"]).groupBy("archive_id", "root", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        new = step.join(seen.select("archive_id", "root", "node"), ["archive_id", "root", "node"], "left_anti")
        new = new.select("archive_id", "root", "node", F.lit(level).alias("hops"), F.concat("path", F.array("node")).alias("path"))
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


class Labels(NamedTuple):
    """levels: for each number of hops the nodes (archive_id, node, root, parent, place) that are first reached then; place orders them."""

    levels: list[DataFrame]

    def table(self) -> DataFrame:
        """(archive_id, node, root, hops, parent) of every node that is reached."""
        parts = [level.select("archive_id", "node", "root", F.lit(hops).alias("hops"), "parent") for hops, level in enumerate(self.levels)]
        return reduce(DataFrame.unionByName, parts)


def label(edges: DataFrame, roots: DataFrame) -> Labels:
    """One label for every node that roots(archive_id, root, place) reach: the nearest root (of several the one of least place) and the node before it.

    All archives and roots go level by level, and a node has one label however many roots reach it.  A candidate is compared with
    the labels since the edges were last cut only: once these are half as many as the edges left, edges to nodes that have
    labels go.  Of several nodes before it the one that was itself reached first counts, then the least name.
    """
    edges = kept(edges.select("archive_id", F.col("src").alias("node"), "dst").distinct(), "edges")
    left, recent = edges.count(), 0
    placed = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy("archive_id").orderBy(*by)))  # noqa: E731  the nodes of a level of one archive
    first = roots.groupBy("archive_id", "root").agg(F.min("place").alias("_place"))
    start = placed(first.select("archive_id", F.col("root").alias("node"), "root", F.lit(None).cast("string").alias("parent"), "_place"), "_place", "node").drop("_place")
    levels, seen = [kept(start, "labels")], []
    while True:
        n = levels[-1].count()
        if not n:
            return Labels(levels[:-1] or levels)
        seen.append(levels[-1].select("archive_id", "node"))
        recent += n
        if 2 * recent >= left:
            told = reduce(DataFrame.union, seen).toDF("archive_id", "dst")
            edges, seen, recent = kept(edges.join(told, ["archive_id", "dst"], "left_anti").select("archive_id", "node", "dst"), "edges"), [], 0
            left = edges.count()
        met = levels[-1].join(edges, ["archive_id", "node"])
        best = met.groupBy("archive_id", F.col("dst").alias("_dst")).agg(F.min(F.struct("place", "node", "root")).alias("_b"))
        new = best.select("archive_id", F.col("_dst").alias("node"), "_b.root", F.col("_b.node").alias("parent"), F.col("_b.place").alias("_before"))
        if seen:
            new = new.join(reduce(DataFrame.union, seen), ["archive_id", "node"], "left_anti")
        levels.append(kept(placed(new, "_before", "node").drop("_before"), "labels"))


def labelled_paths(labels: Labels, targets: DataFrame) -> DataFrame:
    """(archive_id, node, root, hops, path) of those targets(archive_id, node) that have a label; paths are followed backwards, and each level is read once."""
    live = targets.select("archive_id", "node").distinct().join(labels.table().drop("parent"), ["archive_id", "node"])
    live = kept(live.select("*", F.col("node").alias("_at"), F.array("node").alias("path")), "paths")
    for hops in range(len(labels.levels) - 1, 0, -1):
        before = labels.levels[hops].select("archive_id", F.col("node").alias("_at"), F.col("parent").alias("_parent"), F.lit(hops).alias("_hops"))
        met = live.join(before, (live["archive_id"] == before["archive_id"]) & (live["_at"] == before["_at"]) & (F.size("path") == F.col("hops") - F.col("_hops") + 1), "left")
        live = met.select(live["archive_id"], "node", "root", "hops", F.coalesce("_parent", live["_at"]).alias("_at"), F.when(F.col("_parent").isNotNull(), F.concat(F.array("_parent"), "path")).otherwise(F.col("path")).alias("path"))
        if hops % 5 == 0:
            live = kept(live, "paths")
    return live.drop("_at")


def reachability(edges: DataFrame, roots: DataFrame, suspicious: DataFrame) -> DataFrame:
    """For suspicious(archive_id, node): root, hops, path, reachable, and of the archive activation_reachable and payment_reachable.

    A class that no root reaches stands with the archive's first root and an empty path, in an archive without roots with an empty name.
    """
    paths = labelled_paths(label(edges, roots), suspicious)
    first = roots.groupBy("archive_id").agg(F.min_by("root", "place").alias("_first"))
    rows = suspicious.select("archive_id", "node").distinct().join(paths, ["archive_id", "node"], "left").join(first, "archive_id", "left")
    reachable = F.col("path").isNotNull()
    rows = rows.select("archive_id", "node", F.coalesce("root", "_first", F.lit("")).alias("root"), "hops", F.coalesce("path", F.array().cast("array<string>")).alias("path"), reachable.alias("reachable"))
    flags = rows.groupBy("archive_id").agg(F.bool_or("reachable").alias("activation_reachable"), F.bool_or(F.col("reachable") & any_in(F.lower("node"), K.PAYMENT_NAMES)).alias("payment_reachable"))
    return rows.join(flags, "archive_id")


def suspicious_classes(given: DataFrame, nodes: DataFrame) -> DataFrame:
    """(archive_id, node): the given classes and those of the graph's nodes(archive_id, node) whose name hints at activation or payment, once each."""
    named = nodes.where(any_in(F.lower("node"), K.CLASS_NAMES))
    return given.select("archive_id", "node").union(named.select("archive_id", "node")).distinct()


def best_roots(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """For targets(archive_id, node) the shortest of their paths over all roots, the least root on ties."""
    hit = paths.join(targets, ["archive_id", "node"])
    best = hit.groupBy("archive_id", "node").agg(F.min_by(F.struct("root", "hops", "path"), F.struct("hops", "root")).alias("b"))
    return best.select("archive_id", "node", "b.*")


def deepest(paths: DataFrame) -> DataFrame:
    """Per archive the longest of the paths, the greatest node on ties."""
    return paths.groupBy("archive_id").agg(F.max_by(F.struct("node", "hops"), F.struct("hops", "node")).alias("b")).select("archive_id", "b.*")
