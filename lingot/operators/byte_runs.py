"""Runs of text in binary columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.batches import slices
from ..functions.runs import wide_runs
from ..functions.text import UNIT


def runs(docs: DataFrame, content: str, pattern: str, least: int, id_column: str = "doc_id") -> DataFrame:
    """(id, start, value): printable ASCII runs of at least ``least`` bytes, with their byte offset.

    The bytes are read as Latin-1, where characters are bytes; the offset of a run is the sum of the lengths of
    the runs and gaps before it.
    """
    latin = F.decode(F.col(content), "ISO-8859-1")
    found = F.regexp_extract_all(latin, F.lit(f"{pattern}{{{least},}}"), F.lit(0))
    gaps = F.split(latin, f"{pattern}{{{least},}}")
    pairs = F.arrays_zip(found.alias("run"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    rows = docs.select(id_column, F.posexplode(pairs).alias("nth", "p")).select(id_column, "nth", F.col("p.run").alias("value"), F.char_length("p.gap").alias("gap"))
    before = F.sum(F.col("gap") + F.char_length("value")).over(Window.partitionBy(id_column).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(id_column, (before - F.char_length("value")).cast("long").alias("start"), "value")


def ascii_runs(docs: DataFrame, content: str, least: int = 4) -> DataFrame:
    return runs(docs, content, r"[\x20-\x7e]", least)


def _between_gaps(docs: DataFrame, units: Column, kept: Callable[[Column], Column], id_column: str) -> DataFrame:
    """(id, value): stretches of at least two kept units. Units are matched one at a time: a repeated group of
    alternatives would recurse once for each character of a long run."""
    marked = F.array_join(F.transform(units, lambda u: F.coalesce(kept(u), F.lit("\x00"))), "")
    rows = docs.select(id_column, F.explode(F.split(marked, r"\x00+")).alias("value"))
    return rows.where(F.char_length("value") >= 2)


def utf8_runs(docs: DataFrame, content: str, id_column: str = "doc_id") -> DataFrame:
    """(id, value): runs of at least two characters in valid UTF-8 that hold one beyond ASCII."""
    units = F.regexp_extract_all(F.decode(F.col(content), "ISO-8859-1"), F.lit(UNIT), F.lit(0))
    decoded = lambda u: F.when(F.char_length(u) > 1, F.encode(u, "ISO-8859-1").cast("string")).when(u.rlike(r"^[\x20-\x7e]$"), u)
    return _between_gaps(docs, units, decoded, id_column).where(F.col("value").rlike(r"[^\x00-\x7f]"))


def utf16_runs(docs: DataFrame, content: str, big_endian: bool = False, id_column: str = "doc_id") -> DataFrame:
    """(id, value): runs of at least two units of UTF-16 from even offsets that are printable ASCII, a tab or a letter.

    A unit is a character of its own: what needs two units breaks a run.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, contents in slices(batches, id_column, "_content"):
            found = [[text for _, text in wide_runs(b or b"", big_endian)] for b in contents.to_pylist()]
            place = pa.array([i for i, runs in enumerate(found) for _ in runs], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(place), pa.array([r for runs in found for r in runs], pa.string())], [id_column, "value"])

    schema = StructType([StructField(id_column, docs.schema[id_column].dataType), StructField("value", StringType())])
    return docs.select(id_column, F.col(content).alias("_content")).mapInArrow(read, schema)
