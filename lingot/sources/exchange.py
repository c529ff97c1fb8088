"""Exchange files of translations, and build reports, as JSON and CSV."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.batches import slices
from ..functions.text import forward_slashes, placeholders
from ..plans.scratch import kept
from .tables import SEPARATOR

ITEM = "struct<id:string,key:string,source:string,kind:string,idx:int,original:string,original_sha256:string,placeholders:array<string>,translation:string>"
PAYLOAD = f"struct<format:string,schema_version:int,source_name:string,source_sha256:string,item_count:int,items:array<{ITEM}>>"
#: As items are read: idx is also called index, and a translation may be anything.
READ = ITEM.replace("idx:int", "idx:int,index:int").replace("translation:string", "translation:variant")
ITEM_FIELDS = ("id", "key", "source", "kind", "idx", "original", "original_sha256", "placeholders", "translation")
FORMAT_V2 = "exchange-v2"
#: Characters of a name of an object beyond which Spark's reader of JSON gives up on the whole text.
LONGEST_NAME = 50_000


def patched_paths(reports: DataFrame, json: str) -> DataFrame:
    """Distinct normalised paths of the patched items of JSON build reports."""
    rows = reports.select(F.explode(F.from_json(json, "struct<items:array<struct<source:string,status:string>>>").getField("items")).alias("i"))
    return rows.where("i.status = 'PATCHED'").select(forward_slashes("i.source").alias("path")).distinct()


def export_payloads(strings: DataFrame, group: str, order: list[str]) -> DataFrame:
    """One JSON exchange file per group of strings (id, key, source, kind, idx, value, translation)."""
    item = F.struct("id", "key", "source", "kind", F.col("idx").cast("int").alias("idx"), F.col("value").alias("original"), F.sha2("value", 256).alias("original_sha256"), placeholders("value").alias("placeholders"), F.coalesce("translation", F.lit("")).alias("translation"))
    rows = strings.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("_item")))).alias("_rows"))
    digest = F.sha2(F.array_join(F.transform("_rows", lambda r: r["_item"]["original_sha256"]), ""), 256)
    payload = F.struct(F.lit(FORMAT_V2).alias("format"), F.lit(2).alias("schema_version"), F.col(group).cast("string").alias("source_name"), digest.alias("source_sha256"), F.size("_rows").alias("item_count"), F.transform("_rows", lambda r: r["_item"]).alias("items"))
    return rows.select(group, F.size("_rows").alias("item_count"), digest.alias("source_sha256"), F.to_json(payload).alias("json"))


def _large_dictionaries(rows: DataFrame) -> DataFrame:
    """rows with pos, original and translation of their dictionaries in the place of _text, each original once; one that is no JSON has none."""
    names = [c for c in rows.columns if c != "_text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *columns, texts in slices(batches, *names, "_text"):
            for i, text in enumerate(texts.to_pylist()):
                try:
                    found = json.loads(text, object_pairs_hook=list)
                except ValueError:
                    continue
                whole = lambda v: v.encode("utf-8", "replace").decode() if isinstance(v, str) else None
                said: dict = {}  # the place of the first and the value of the last
                for place, (k, v) in enumerate(found):
                    k = whole(k)
                    said[k] = (said[k][0] if k in said else place, whole(v))
                told = [pa.array([p for p, _ in said.values()], pa.int32()), pa.array(list(said), pa.string()), pa.array([v for _, v in said.values()], pa.string())]
                same = pa.array([i] * len(said), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(same) for c in columns), *told], [*names, "pos", "original", "translation"])

    kinds = [rows.schema[c] for c in names] + [StructField("pos", IntegerType()), StructField("original", StringType()), StructField("translation", StringType())]
    return rows.mapInArrow(read, StructType(kinds))


def read_payloads(files: DataFrame, column: str = "json") -> DataFrame:
    """Rows of exchange files of any form: version 2, version 1 (items), a bare list, or {original: translation}.

    In the place of the JSON they have form (v2, v1, list, dictionary, unknown), pos and present: the names of the fields that an item has, null where it is no
    object.  A dictionary gives original and translation alone, an original that repeats with its last translation; a
    translation that is no text is null.  Files of unknown form, and those without items, give no rows.
    """
    text = F.ltrim(F.ltrim(F.col(column), F.lit("\ufeff")))
    form = (
        F.when(text.startswith("["), "list")
        .when(F.get_json_object(text, "$.format") == FORMAT_V2, "v2")
        .when(F.ltrim(F.get_json_object(text, "$.items")).startswith("["), "v1")
        .when(text.startswith("{"), "dictionary")
        .otherwise("unknown")
    )
    carried = [c for c in files.columns if c != column]
    keys = F.json_object_keys(text)
    twice = F.when(form == "dictionary", F.coalesce(F.size(keys) > F.size(F.array_distinct(keys)), F.lit(True)))  # names that repeat, or may
    rows = kept(files.select(*carried, form.alias("form"), text.alias("_text"), twice.alias("_twice")), "payloads")  # read by items and by dictionaries
    raw = F.when(F.col("form") == "list", F.from_json("_text", "array<string>")).when(F.col("form").isin("v1", "v2"), F.from_json("_text", "struct<items:array<string>>").getField("items"))
    item = rows.where("form in ('list', 'v1', 'v2')").select(*carried, "form", F.posexplode(raw).alias("pos", "_item"))
    names = F.transform(F.json_object_keys("_item"), lambda k: F.when(k == "idx", "index").otherwise(k))
    item = item.withColumn("present", names).withColumn("_i", F.when(F.col("present").isNotNull(), F.from_json("_item", READ)))
    said = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    fields = {c: F.col(f"_i.{c}") for c in ITEM_FIELDS} | {"idx": F.coalesce("_i.idx", "_i.index"), "translation": said(F.col("_i.translation"))}
    items = item.select(*carried, "form", "pos", "present", *[v.alias(c) for c, v in fields.items()])
    dictionaries, large = rows.where("form = 'dictionary'"), F.char_length("_text") > LONGEST_NAME
    columns = [*carried, "form", "pos", "original", "translation"]

    def pairs(which: DataFrame) -> DataFrame:
        got = which.select(*carried, "form", F.posexplode(F.map_entries(F.from_json("_text", "map<string,variant>"))).alias("pos", "_e"))
        return got.withColumns({"original": F.col("_e.key"), "translation": said(F.col("_e.value"))}).select(*columns)

    small = dictionaries.where(~large)
    last = pairs(small.where("_twice")).groupBy(*carried, "form", "original").agg(F.max_by(F.struct("translation"), "pos").alias("_t"), F.min("pos").alias("pos"))
    told = last.withColumn("translation", F.col("_t.translation")).select(*columns)
    told = told.unionByName(pairs(small.where("not _twice"))).unionByName(_large_dictionaries(dictionaries.where(large).select(*carried, "form", "_text")))
    return items.unionByName(told, allowMissingColumns=True)


def csv_rows(rows: DataFrame) -> DataFrame:
    """Rows of a CSV of translations: a missing key is made anew from source, kind, index (-1 if bad) and original; empty translations go."""
    made = F.concat_ws(SEPARATOR, "source", "kind", F.coalesce(F.expr("try_cast(index as int)"), F.lit(-1)).cast("string"), "original")
    return rows.withColumn("key", F.coalesce(F.nullif("key", F.lit("")), made)).withColumn("translation", F.trim(F.coalesce("vietnamese", F.lit("")))).where("translation <> ''")


def import_csv(rows: DataFrame, strings: DataFrame, file: str = "file_id", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(updates, counts) of CSV rows: what each known key gets, the last row of a key within a file, and rows imported and skipped by file.

    Rows without a translation and rows whose key no string has are skipped.
    """
    known = strings.select("key").distinct().withColumn("_known", F.lit(True))
    usable = csv_rows(rows).select(file, pos, "key", "translation").join(known, "key")
    updates = usable.groupBy(file, "key").agg(F.max_by("translation", pos).alias("translation"))
    imported = usable.groupBy(file).agg(F.count(F.lit(1)).alias("imported"))
    counts = rows.groupBy(file).agg(F.count(F.lit(1)).alias("rows")).join(imported, file, "left")
    return updates, counts.select(file, F.coalesce("imported", F.lit(0)).alias("imported"), (F.col("rows") - F.coalesce("imported", F.lit(0))).alias("skipped"))


def write_wide_csv(rows: DataFrame, path: str) -> None:
    """key, source, source_type, score, kind, index, encoding, original, vietnamese."""
    rows.select("key", "source", "source_type", "score", "kind", "index", "encoding", "original", "vietnamese").write.option("header", True).option("quoteAll", True).csv(path)


def scan_json(strings: DataFrame, group: list[str]) -> DataFrame:
    """One JSON object per source with its strings in order."""
    rows = strings.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("idx", "value", "kind"))).alias("strings"))
    return rows.select(*group, F.size("strings").alias("n"), F.to_json(F.struct(*group, "strings")).alias("json"))
