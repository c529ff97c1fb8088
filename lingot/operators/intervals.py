"""Text fields found in binary content as intervals: candidates, conflicts, regions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields, legacy
from ..functions.batches import slices
from ..plans.scratch import kept

WIDTH = 4096
#: Candidates that are handed back at a time, but for those of one content.
ROWS = 200_000
#: Bytes of contents that are searched for players' texts together.
TOGETHER = 1 << 17


def exclude_regions(points: DataFrame, regions: DataFrame, group: str, at: str = "at") -> DataFrame:
    """Points outside all regions(group, start, end) of their group: a range anti-join by blocks of ``WIDTH``."""
    blocks = regions.select(F.col(group).alias("_g"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor((F.col("end") - 1) / WIDTH))).alias("_b"))
    hit = (F.col(group) == F.col("_g")) & (F.floor(F.col(at) / WIDTH) == F.col("_b")) & (F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))
    return points.join(blocks, hit, "left_anti")


def strongest(candidates: DataFrame, group: str) -> DataFrame:
    """Of overlapping candidates(group, start, length, safe, confidence) the strongest that fit together.

    Order: safe first, then confidence, then short, then early (equal ones once); short and early are told by text_length
    and text_start where there are such columns, else by the interval.  As taking them one by one:
    each round keeps those that beat every overlapping one that is still there, and drops what they overlap.
    Overlaps are found by blocks; a round needs one range join, and rounds end when nothing is left.
    """
    rows = candidates.dropDuplicates([group, "start", "length"]) if "framing" not in candidates.columns else candidates.dropDuplicates([group, "start", "length", "framing"])
    ties = ["framing"] if "framing" in candidates.columns else []
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("safe"), F.desc("confidence"), *(c if c in candidates.columns else c[5:] for c in ("text_length", "text_start")), *ties))
    live = kept(rows.withColumn("_rank", rank), "intervals")
    out = None
    while not live.isEmpty():
        ends = F.col("start") + F.col("length")
        cut = live.select(group, "_rank", "start", ends.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor((ends - 1) / WIDTH))).alias("_b"))
        other = cut.select(*[F.col(c).alias(f"_o{c}") for c in cut.columns])
        meet = (F.col(group) == F.col(f"_o{group}")) & (F.col("_b") == F.col("_o_b")) & (F.col("start") < F.col("_oend")) & (F.col("_ostart") < F.col("end")) & (F.col("_o_rank") < F.col("_rank"))
        beaten = cut.join(other, meet, "left_semi").select(group, "_rank").distinct()
        won = kept(live.join(beaten, [group, "_rank"], "left_anti"), "winners")
        out = won if out is None else out.unionByName(won)
        mine = won.select(group, F.col("start").alias("_s"), (F.col("start") + F.col("length")).alias("_e"), F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor((F.col("start") + F.col("length") - 1) / WIDTH))).alias("_b"))
        hit = cut.join(mine, [group, "_b"]).where("start < _e and _s < end").select(group, "_rank").distinct()
        live = kept(live.join(hit, [group, "_rank"], "left_anti"), "intervals")
    return (out if out is not None else live).drop("_rank")


def _fields(docs: DataFrame, content: str, pick: Callable[[bytes], dict[str, np.ndarray]], text: bool) -> DataFrame:
    """The fields that ``pick`` finds in each content, a bounded number of rows at a time."""
    names = ("start", "length", "framing", "confidence", "safe", "codec")
    schema = "doc_id long, start int, length int, framing int, confidence int, safe boolean, codec int" + (", text string" if text else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts, rows = [], 0
            for doc_id, data in zip(b["doc_id"], b["content"], strict=True):
                found = pick(data)
                part = {"doc_id": np.full(len(found["start"]), doc_id), **{k: found[k] for k in names}}
                if text:
                    part["text"] = np.array([fields.text_of(data, found, i) for i in range(len(found["start"]))], dtype=object)
                parts.append(part)
                rows += len(found["start"])
                if rows >= ROWS:
                    yield pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in part})
                    parts, rows = [], 0
            if parts:
                yield pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})

    rows = docs.where(F.octet_length(content) >= 3).select("doc_id", F.col(content).alias("content")).mapInPandas(read, schema)
    names_of = F.array(*[F.lit(f) for f in fields.FRAMINGS])
    codec_of = F.array(*[F.lit(c) for c in legacy.CODECS])
    rows = rows.withColumn("framing", F.get(names_of, F.col("framing"))).withColumn("encoding", F.get(codec_of, F.col("codec"))).drop("codec")
    return rows.select(*[c for c in rows.columns if c != "text"], *(["text"] if text else []))


def framed_candidates(docs: DataFrame, content: str = "content", text: bool = True) -> DataFrame:
    """(doc_id, start, length, framing, confidence, safe, encoding, and on request text): every offset read as an 8-bit or 16-bit length before text, and text before a zero byte.

    A text is UTF-8, else what the best of the Chinese codecs makes of it, else Latin-1 (before a zero byte islands of UTF-8 come first).

    start and length are those of the whole frame: length field and text, or text and zero byte.
    """
    return _fields(docs, content, fields.candidates, text)


def strongest_fields(docs: DataFrame, content: str = "content", text: bool = False) -> DataFrame:
    """``strongest`` of the framed candidates of each content, found where the content is, without dealing out its candidates; with their texts on request."""

    def pick(data: bytes) -> dict[str, np.ndarray]:
        found = fields.candidates(data)
        won = fields.strongest(found, len(data))
        return {k: v[won] for k, v in found.items()}

    return _fields(docs, content, pick, text)


def _joined(data: bytes) -> str:
    """Modified UTF-8 without zero characters, its surrogate pairs as one character each."""
    halves = data.decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass")
    return halves.decode("utf-16-le", "surrogatepass").encode("utf-8", "replace").decode()


def player_texts(docs: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, start, length, text): texts for players at any offset of each content, as modified UTF-8 behind its 16-bit big-endian length.

    start is that of the text.  Of frames that overlap the one that starts first stays, then the next that starts behind it.  A null
    or short content gives no rows; a half of a surrogate pair without the other is returned as a question mark.
    """

    names = ("doc_id", "start", "length", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, contents in slices(batches, "doc_id", "content", most=TOGETHER):
            data = contents.to_pylist()
            which, at, end = fields.player_texts(*data)
            for i in range(0, len(at), ROWS):
                w, s, e = which[i : i + ROWS], at[i : i + ROWS] + 2, end[i : i + ROWS]
                raw = [data[k][a:z] for k, a, z in zip(w.tolist(), s.tolist(), e.tolist(), strict=True)]
                texts = [_joined(x) if b"\xed" in x else x.decode() for x in raw]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(w)), pa.array(s, pa.int32()), pa.array(e - s, pa.int32()), pa.array(texts, pa.string())], names)

    return docs.where(F.octet_length(content) >= 3).select(F.col("doc_id").cast("long"), F.col(content).alias("content")).mapInArrow(read, "doc_id long, start int, length int, text string")


def format_summary(found: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Per document: its framing, or mixed-framing, the best confidence (99 at most), and how many fields are safe.

    Of contents(doc_id, content) those without a field count as raw/unknown: 45 with a run of four printable bytes, else 10.
    """
    got = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("framing")).alias("f"), F.least(F.lit(99), F.max("confidence")).alias("confidence"), F.count_if("safe").alias("safe"), F.count(F.lit(1)).alias("fields"))
    got = got.select("doc_id", F.when(F.size("f") == 1, F.col("f")[0]).otherwise("mixed-framing").alias("format_name"), "confidence", "safe", "fields")
    if contents is None:
        return got
    got = kept(got, "formats")  # read twice: the fields are looked for once
    rest = contents.join(got.select("doc_id"), "doc_id", "left_anti")
    runs = F.decode("content", "ISO-8859-1").rlike(r"[\x20-\x7e]{4,}")
    zero = F.lit(0).cast("long")
    return got.unionByName(rest.select("doc_id", F.lit("raw/unknown").alias("format_name"), F.when(runs, 45).otherwise(10).alias("confidence"), zero.alias("safe"), zero.alias("fields")))


def supplement(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """primary and those of extra whose (source, idx, value) it lacks, once each."""
    key = ["source", "idx", "value"]
    more = extra.join(primary, key, "left_anti").dropDuplicates([*key])
    return primary.unionByName(more)
