"""Decoding of bytes whose encoding is not known; codecs that Spark lacks run as an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import legacy
from .batches import slices
from .text import mixed_islands, quality_score, script_count

# Codecs that are tried, in order.
CODECS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "big5", "utf-16", "utf-16le", "utf-16be", "cp1252", "latin-1")

# The Chinese codecs of fields, in order.
LEGACY = ("gb18030", "gbk", "big5")

_DECODED = T.ArrayType(T.StructType([T.StructField("codec", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_DECODED)
def decodings(data: pd.Series) -> pd.Series:
    """Every codec that decodes the bytes without error, and the text."""

    def one(b: bytes | None) -> list[dict[str, str]]:
        out = []
        for c in CODECS:
            try:
                text = (b or b"").decode(c)
                text.encode("utf-8")
            except UnicodeError:
                continue
            out.append({"codec": c, "text": text})
        return out

    return data.map(one)


@F.arrow_udf(T.BooleanType())
def encodable(text: pa.Array, codec: pa.Array) -> pa.Array:
    """Whether a text can be written in a codec."""

    def one(t: str | None, c: str) -> bool:
        try:
            (t or "").encode(c)
        except (UnicodeError, LookupError):
            return False
        return True

    return pa.array((one(t.as_py(), c.as_py()) for t, c in zip(text, codec, strict=True)), pa.bool_())


_AS_BYTES = str.maketrans({bytes((b,)).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)})


def _mended(text: str) -> tuple[float, str]:
    """``quality_score`` and text after ``repair_mojibake``."""
    score = legacy.quality(text)
    if any(m in text for m in legacy.MARKS):
        for raw in (text, text.translate(_AS_BYTES)):
            try:
                other = raw.encode("latin-1").decode()
            except UnicodeError:
                continue
            told = legacy.quality(other)
            if told > score + 0.08:
                return told, other
    return score, text


def ranked_decodings(data: bytes) -> list[tuple[str, str]]:
    """Codec and text of every decoding, equal ones once by their first codec, the best quality first and the first codec on ties."""
    seen: set[str] = set()
    told = []
    for place, codec in enumerate(CODECS):
        try:
            raw = data.decode(codec)
            raw.encode("utf-8")
        except UnicodeError:
            continue
        if raw in seen:
            continue
        seen.add(raw)
        score, text = _mended(raw)
        told.append((-round(score, 9), place, codec, text))
    same: set[str] = set()
    ordered = []
    for _, place, codec, text in sorted(told, key=lambda t: t[1]):
        if text not in same:
            same.add(text)
            ordered.append((_, place, codec, text))
    return [(codec, text) for _, _, codec, text in sorted(ordered, key=lambda t: t[:2])]


def best_decoding(docs: DataFrame, data: str, id_column: str) -> DataFrame:
    """(id, codec, text): the decoding of best quality, the first codec on ties; equal texts count once, and a null is an empty text.

    A content's decodings are told apart where it is; only the best goes on.
    """
    kind = docs.schema[id_column].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, contents in slices(batches, id_column, "_data"):
            best = [ranked_decodings(b or b"")[0] for b in contents.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array([c for c, _ in best], pa.string()), pa.array([t for _, t in best], pa.string())], [id_column, "codec", "text"])

    schema = T.StructType([T.StructField(id_column, kind), T.StructField("codec", T.StringType()), T.StructField("text", T.StringType())])
    return docs.select(id_column, F.col(data).alias("_data")).mapInArrow(read, schema)


def field_text(data: Column) -> Column:
    """struct(text, encoding) of a field: strict UTF-8, else UTF-8 islands with two CJK characters, else the best of the Chinese codecs, Latin-1 where none of these decodes it, else ASCII; null without a letter."""
    letters = lambda c: c.rlike(r"\p{L}")
    strict = F.try_validate_utf8(data.cast("string"))
    islands = mixed_islands(data)
    best = F.array_max(F.transform(F.filter(decodings(data), lambda d: d["codec"].isin(*LEGACY)), lambda d: F.struct(F.round(quality_score(d["text"]), 9).alias("quality"), (-F.array_position(F.array(*[F.lit(c) for c in LEGACY]), d["codec"])).alias("place"), d["text"].alias("text"), d["codec"].alias("codec"))))
    legacy = F.struct(best["text"].alias("text"), best["codec"].alias("encoding"))
    as_field = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("encoding"))
    latin = F.decode(data, "ISO-8859-1")
    return F.when(letters(strict), as_field(strict, "utf-8")).when(script_count(islands) >= 2, as_field(islands, "mixed-utf8")).when(letters(legacy["text"]), legacy).when(best.isNull() & letters(latin), as_field(latin, "latin-1")).when(letters(islands) & islands.rlike(r"^[\x00-\x7f]*$"), as_field(islands, "ascii"))


# Units of the Chinese codecs: four bytes, two bytes, or one printable ASCII byte.
UNITS = {
    "gb18030": rb"[\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39]|[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x20-\x7e\t\n\r]",
    "big5": rb"[\x81-\xfe](?:[\x40-\x7e]|[\xa1-\xfe])|[\x20-\x7e\t\n\r]",
}
_UNIT = {c: re.compile(u) for c, u in UNITS.items()}
_RUN = {c: re.compile(b"(?:" + u + b")+") for c, u in UNITS.items()}
#: Bytes at which a run is cut.
MOST_RUN = 4096
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(T.BinaryType())
def encoded(text: pd.Series, codec: pd.Series) -> pd.Series:
    """A text's bytes in a codec; null where it can't be written."""

    def one(t: str | None, c: str) -> bytes | None:
        try:
            return None if t is None else t.encode(c)
        except (UnicodeError, LookupError):
            return None

    return pd.Series([one(t, c) for t, c in zip(text, codec, strict=True)], dtype=object)


_CJK = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\u31f0-\u31ff\uac00-\ud7af]")


def legacy_runs_of(data: bytes, codec: str) -> list[tuple[int, str]]:
    """Start and text of ``legacy_runs`` of one content."""
    runs: list[tuple[int, int]] = []
    for run in _RUN[codec].finditer(data):
        start, end = run.span()
        if end - start > MOST_RUN:  # cut behind the unit that reaches the limit
            for u in _UNIT[codec].finditer(data, start, end):
                if u.start() - start >= MOST_RUN:
                    runs.append((start, u.start()))
                    start = u.start()
        runs.append((start, end))
    out = []
    for start, end in runs:
        try:
            text = data[start:end].decode(codec)
        except UnicodeError:
            continue
        if len(_CJK.findall(text)) >= 2:
            out.append((start, text))
    return out


@F.pandas_udf(_RUNS)
def legacy_runs(data: pd.Series, codec: pd.Series) -> pd.Series:
    """(start, text) of the runs of a Chinese codec's units in arbitrary bytes, cut into further runs where they reach 4,096 bytes, that decode and hold two CJK characters."""
    return pd.Series([[{"start": s, "text": t} for s, t in legacy_runs_of(b or b"", c)] for b, c in zip(data, codec, strict=True)])
