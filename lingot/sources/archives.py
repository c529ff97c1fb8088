"""Entries of zip archives, as a table over a whole corpus, and what diagnostic bundles hold."""

from __future__ import annotations

import contextlib
import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import base_name, extension

ENTRY = "archive_id string, pos int, source string, size long, content binary"
ENTRY_COLUMNS = ["archive_id", "pos", "source", "size", "content"]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]


def should_scan(source: Column, size: Column, deep: bool = False) -> Column:
    """Which entries are worth reading, by name and size alone."""
    known = extension(source).isin(*K.TEXT_EXTENSIONS, *K.BINARY_EXTENSIONS, "class")
    if deep:
        return known & (size <= K.MOST_READ) | (size > 0) & (size <= K.MOST_DEEP) & ~extension(source).isin(*K.SKIPPED_EXTENSIONS)
    return known & (size <= K.MOST_READ)


#: Bytes of members that are handed on at once; a larger member stands alone.
BATCH_BYTES = 8 * 1024 * 1024


def _reads(name: str, size: int, deep: bool) -> bool:
    """``should_scan`` of one member, so that the others are never unpacked."""
    ext = name.replace("\\", "/").rpartition("/")[2].lower()
    ext = ext.rpartition(".")[2] if "." in ext else ""
    if ext in (*K.TEXT_EXTENSIONS, *K.BINARY_EXTENSIONS, "class") and size <= K.MOST_READ:
        return True
    return deep and 0 < size <= K.MOST_DEEP and ext not in K.SKIPPED_EXTENSIONS


def members(archives: DataFrame, read: Callable[[str, int], bool] = lambda name, size: size <= K.MOST_READ) -> DataFrame:
    """(archive_id, pos, source, size, content) of every member of archives(archive_id, content), in their order; folders are none.

    content is null where ``read`` says so by name and size, and where a member can't be unpacked; a member is unpacked only when it is its
    turn, and some megabytes are handed on at a time.  What is no archive, or null, has no members.
    """

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("archive_id").to_pylist(), b.column("content"), strict=True):
                if not data.is_valid:
                    continue
                rows, size = [], 0
                try:
                    z = zipfile.ZipFile(pa.BufferReader(data.as_buffer()))
                except (zipfile.BadZipFile, OSError):
                    continue
                for pos, i in enumerate(x for x in z.infolist() if not x.is_dir()):
                    content = None
                    if read(i.filename, i.file_size):
                        with contextlib.suppress(zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, zlib.error):
                            content = z.read(i)
                    rows.append((name, pos, i.filename, i.file_size, content))
                    size += len(content or b"")
                    if size >= BATCH_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], ENTRY_COLUMNS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], ENTRY_COLUMNS)

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInArrow(unzip, ENTRY)


def archive_files(spark: SparkSession, path: str, pattern: str = "*.jar") -> DataFrame:
    """(archive_id, content) of all archives under a path; archive_id is the file's own path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("archive_id"), "content")


def entries(spark: SparkSession, path: str, pattern: str = "*.jar", most: int = K.MOST_READ) -> DataFrame:
    """(archive_id, pos, source, size, content): members of all archives under a path; folders, too large ones and unreadable ones are left out."""
    return members(archive_files(spark, path, pattern), lambda name, size: size <= most).where("content is not null")


def pack(entries: DataFrame) -> DataFrame:
    """(archive_id, content): archives of entries(archive_id, pos, source, content), which together fit in memory; the same entries give the same bytes."""

    def zipped(part: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, content in part.sort_values("pos")[["source", "content"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), bytes(content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"archive_id": [part["archive_id"].iloc[0]], "content": [data.getvalue()]})

    rows = entries.select(F.col("archive_id").cast("string").alias("archive_id"), "pos", "source", "content")
    return rows.groupBy("archive_id").applyInPandas(zipped, "archive_id string, content binary")


def unsafe_path(source: Column) -> Column:
    """Absolute, or climbing out of its folder."""
    return source.rlike(r"^/|^[A-Za-z]:|(?:^|[/\\])\.\.(?:[/\\]|$)")


def inspect_bundles(entries: DataFrame, most_entries: int = 64, most_bytes: int = 4 * 1024 * 1024) -> DataFrame:
    """One row per bundle: its manifest, report, diagnosis and log, whether it is safe and whether it is complete."""
    name = F.lower(base_name("source"))
    text = F.when(F.col("size") <= most_bytes, F.try_validate_utf8(F.col("content").cast("string")))
    known = {"manifest": "bundle_manifest.json", "report": "compatibility_report.json", "diagnosis": "runtime_diagnosis.json", "timeline": "runtime_timeline.json"}
    rows = entries.withColumns({"_name": name, "_text": text})
    found = {k: F.max(F.when(F.col("_name") == v, F.col("_text"))).alias(k) for k, v in known.items()}
    other = ~F.col("_name").isin(*known.values()) & F.col("_name").rlike(r"\.(?:log|txt)$")
    got = rows.groupBy("archive_id").agg(*found.values(), F.min(F.when(other, F.col("source"))).alias("log_source"), F.count(F.lit(1)).alias("n"), F.bool_or(unsafe_path(F.col("source"))).alias("unsafe"), F.count_if(F.col("size") > most_bytes).alias("skipped"))
    is_json = lambda c: F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False))
    rejected = F.when(F.col("n") > most_entries, "too many entries").when(F.col("unsafe"), "unsafe path")
    return got.withColumn("rejected", rejected).withColumn("valid", F.col("rejected").isNull() & is_json("manifest") & is_json("diagnosis"))
