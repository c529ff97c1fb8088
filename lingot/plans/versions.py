"""A keyed table kept in versions in one shared folder: a base, deltas behind it, and a manifest for each version.

A version writes only the rows that it changes, sorted by key, into a folder of its own; then one small file, the manifest,
says of which folders the version is made, with their key ranges.  A version is there when its manifest is, and that
file appears at once, so a reader sees all of a version or none of it.  Folders are never changed: older versions can be
read, and a failed write leaves a folder that no manifest names.  After some deltas the next version writes a new base.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "lingot-store-1"
#: Deltas behind a base before the next version writes a new base.
MOST_DELTAS = 8
MANIFEST = "format string, version long, autosave boolean, nth int, folder string, low string, high string, rows long, schema string"


class Version(NamedTuple):
    """rows: the table; version: its number; dirty: whether it is a recovery snapshot that was not saved; folders: of how many folders it is made."""

    rows: DataFrame
    version: int
    dirty: bool
    folders: int


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The manifest's rows of a version, or of the last one; none if there is none."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{path}/manifests/*")
        if version is None:
            version = found.agg(F.max("version")).first()[0]
        return found.where(F.col("version") == version).orderBy("nth").collect()  # MOST_DELTAS + 1 rows at most
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def _merged(spark: SparkSession, path: str, rows: list, key: str) -> DataFrame:
    """The last row of each key over the folders; a key that was deleted last is gone."""
    schema = rows[0]["schema"]
    if len(rows) == 1:
        return spark.read.schema(f"{schema}, _gone boolean").parquet(f"{path}/data/{rows[0]['folder']}").where("not _gone").drop("_gone")
    parts = [spark.read.schema(f"{schema}, _gone boolean").parquet(f"{path}/data/{r['folder']}").withColumn("_nth", F.lit(r["nth"])) for r in rows]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    values = [c for c in every.columns if c not in (key, "_nth")]
    last = every.groupBy(key).agg(F.max_by(F.struct(*values), "_nth").alias("_last"))
    return last.select(key, "_last.*").where("not _gone").drop("_gone")


def load(spark: SparkSession, path: str, key: str = "key", version: int | None = None, low: str | None = None, high: str | None = None) -> Version | None:
    """A version, the last one by default; None if there is none.  With ``low`` and ``high`` only folders that may hold keys between them are read.

    A folder of another format is an error.
    """
    rows = _manifest(spark, path, version)
    if not rows:
        return None
    if any(r["format"] != FORMAT for r in rows):
        raise ValueError(f"no store of format {FORMAT}: {rows[0]['format']}")
    near = [r for r in rows if low is None or high is None or r["low"] is None or not (r["high"] < low or high < r["low"])] or rows[:1]
    return Version(_merged(spark, path, near, key), rows[0]["version"], rows[0]["autosave"], len(rows))


def commit(spark: SparkSession, path: str, changes: DataFrame, version: int, key: str = "key", gone: DataFrame | None = None, autosave: bool = False, most_deltas: int = MOST_DELTAS) -> int:
    """Writes ``version``: the last version before it with changes (one row for each key) in the place of rows of their keys, and without the keys ``gone``.

    A version that is there already stays as it is, so a writer that starts again may repeat its commit.  One writer
    commits at a time.  Returns the number of rows written.
    """
    if _manifest(spark, path, version):
        return 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema)
    before = _manifest(spark, path)
    if before and before[0]["schema"] != schema:
        raise ValueError(f"columns of the store: {before[0]['schema']}")
    rows = changes.withColumn("_gone", F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.select(key, F.lit(True).alias("_gone")), allowMissingColumns=True)
    folder = uuid.uuid4().hex
    if len(before) > most_deltas:
        told = rows.select(key, F.lit(True).alias("_new"))
        old = _merged(spark, path, before, key).join(told, key, "left_anti").withColumn("_gone", F.lit(False))
        rows, before = old.unionByName(rows).where("not _gone"), []
    rows.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{path}/data/{folder}")
    written = spark.read.schema(f"{schema}, _gone boolean").parquet(f"{path}/data/{folder}")
    told = written.agg(F.min(F.col(key).cast("string")).alias("low"), F.max(F.col(key).cast("string")).alias("high"), F.count(F.lit(1)).alias("rows")).first()
    entries = [(FORMAT, version, autosave, i, r["folder"], r["low"], r["high"], r["rows"], schema) for i, r in enumerate(before)]
    entries.append((FORMAT, version, autosave, len(before), folder, told["low"], told["high"], told["rows"], schema))
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifests/v={version}")
    return told["rows"]
