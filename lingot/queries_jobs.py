"""Queries of whole jobs and of the remaining sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import codecs
from .functions import constants as K
from .operators import archive_scan as A
from .operators import graph as G
from .operators import rewrite as R
from .operators import scan as J
from .plans.dealing import dealt
from .plans.scratch import kept
from .queries_compat import _NEXT, _RANK, ACTED, ASSESSED, EDGES, _assessed
from .queries_text import LINES, TRANSLATED
from .sources import archives
from .sources import tables as src


def s1_pruned_entries(spark, sf_dir):
    """Which pages would be read as entries, by name and size alone."""
    pages = src.read(spark, sf_dir, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".txt").when(F.col("page_id") % 3 == 1, ".png").otherwise(".odd")).alias("source"), (F.octet_length("html") * 400).alias("size"))
    return pages.select("page_id", archives.should_scan(F.col("source"), F.col("size")).alias("fast"), archives.should_scan(F.col("source"), F.col("size"), deep=True).alias("deep"))


def s9_wide_rows(spark, sf_dir):
    s = src.strings(spark, sf_dir)
    rows = s.join(src.translations(s), "key", "left")
    return rows.select("doc_id", "idx", F.sha2("key", 256).alias("key_sha256"), "source", F.lit("text").alias("source_type"), "kind", F.lit("utf-8").alias("encoding"), F.coalesce("translation", F.lit("")).alias("vietnamese"))


def s12_report_text(spark, sf_dir):
    return J.report_text(_assessed(spark, sf_dir), "COMPATIBILITY REPORT", ["compatibility_score", "runtime_risk", "startup_classification", "next_action"])


def s13_unsafe_members(spark, sf_dir):
    pages = src.read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("../"), F.col("url"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/"), F.col("url"))).otherwise(F.col("url")).alias("member"))
    return pages.select("page_id", archives.unsafe_path(F.col("member")).alias("unsafe"))


# A character for each letter.
HAN = "的一是不了人我在有他这中大来上国个到说们为子和你地出"
TRADITIONAL = "的一是不了人我在有他這中大來上國個到說們為子和你地出"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def e4_legacy_runs(spark, sf_dir):
    """Lines told in Han characters, written in GB18030 between control bytes, found again."""
    told = F.translate(F.regexp_replace(F.lower("value"), "[^a-z]", ""), LETTERS, HAN)
    rows = src.lines(spark, sf_dir).select("doc_id", "idx", told.alias("told")).where(F.char_length("told") >= 2)
    data = F.concat(F.unhex(F.lit("0001")), codecs.encoded("told", F.lit("gb18030")), F.unhex(F.lit("00")))
    return rows.select("doc_id", "idx", F.explode(codecs.legacy_runs(data, F.lit("gb18030"))).alias("r")).select("doc_id", "idx", "r.start", "r.text")


def e4_big5_runs(spark, sf_dir):
    """The same lines in Big5, whose characters that it lacks part the runs; found again by kind of run."""
    told = F.translate(F.regexp_replace(F.lower("value"), "[^a-z]", ""), LETTERS, TRADITIONAL)
    rows = src.lines(spark, sf_dir).select("doc_id", "idx", told.alias("told")).where(F.char_length("told") >= 2)
    data = F.concat(F.unhex(F.lit("0001")), codecs.encoded("told", F.lit("big5")), F.unhex(F.lit("00")))
    found = rows.select("doc_id", "idx", F.explode(codecs.legacy_runs(data, F.lit("big5"))).alias("r"))
    return found.select("doc_id", "idx", "r.start", "r.text")


def e5_best_decoding(spark, sf_dir):
    """The codec chosen for every document, written in UTF-8, UTF-16 or Latin-1 by its number."""
    turn = F.col("doc_id") % 3
    latin = F.when(F.col("text").rlike(r"^[\x{0}-\x{ff}]*$"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "utf-8"))
    docs = src.read(spark, sf_dir, "documents").select("doc_id", F.when(turn == 0, F.encode("text", "utf-8")).when(turn == 1, F.encode("text", "UTF-16")).otherwise(latin).alias("data"))
    return codecs.best_decoding(docs, "data", "doc_id").groupBy("codec").agg(F.count(F.lit(1)).alias("n"))


def e12_patch_safe(spark, sf_dir):
    data = F.concat(F.encode("value", "utf-8"), F.when(F.col("idx") % 4 == 1, F.unhex(F.lit("07"))).otherwise(F.unhex(F.lit(""))))
    rows = src.lines(spark, sf_dir).withColumn("data", data)
    from .functions.text import structural_bytes

    safe = ~structural_bytes(F.col("data")) & (F.regexp_count("value", F.lit(r"\p{L}")) >= 2)
    return rows.groupBy("doc_id").agg(F.count_if(safe).alias("safe"), F.count_if(~safe).alias("unsafe"))


def a5_safe_counts(spark, sf_dir):
    return e12_patch_safe(spark, sf_dir).agg(F.sum("safe").alias("safe"), F.sum("unsafe").alias("unsafe"))


def e19_field_text(spark, sf_dir):
    """Fields in UTF-8, in islands of it, in GB18030, in Latin-1 only, and without a letter, by their place."""
    told = codecs.encoded(F.lit("游戏开始"), F.lit("gb18030"))
    turn = F.col("idx") % 4
    data = F.when(turn == 0, F.encode("value", "utf-8")).when(turn == 1, F.concat(F.unhex(F.lit("ff")), F.encode(F.lit("中文"), "utf-8"))).when(turn == 2, told).when(F.col("idx") % 8 == 3, F.unhex(F.lit("ff0041"))).otherwise(F.unhex(F.lit("d731")))
    got = src.lines(spark, sf_dir).select("doc_id", "idx", codecs.field_text(data).alias("f"))
    return got.groupBy(F.coalesce("f.encoding", F.lit("rejected")).alias("encoding")).agg(F.count(F.lit(1)).alias("n"))


def f10_entry_points(spark, sf_dir):
    """Entry points of archives told by orders; half of the archives have keys that name none."""
    orders = src.read(spark, sf_dir, "orders")
    prefix = F.when(F.col("o_orderkey") % 20 < 10, "midlet-").otherwise("icon-")
    manifest = orders.select((F.col("o_orderkey") % 40).alias("archive_id"), F.concat(prefix, (F.col("o_orderkey") % 3).cast("string")).alias("key"), F.concat(F.lit("Game, icon.png, g.C"), (F.col("o_custkey") % 30).cast("string")).alias("value"))
    classes = orders.select((F.col("o_orderkey") % 40).alias("archive_id"), F.concat(F.lit("g.C"), (F.col("o_custkey") % 7).cast("string")).alias("name"))
    return J.entry_points(manifest, classes).distinct()


def f12_startup_ranks(spark, sf_dir):
    rank = F.coalesce(*[F.when(F.col("startup_classification") == k, F.lit(v)) for k, v in K.STARTUP_RANK.items()], F.lit(1))
    return _assessed(spark, sf_dir).select("archive_id", rank.alias("rank"))


def j7_reference_edges(spark, sf_dir):
    """Edges found again in class contents that name the classes they refer to."""
    li = src.read(spark, sf_dir, "lineitem")
    node = lambda c: F.concat(F.lit("g/N"), (F.col(c) % 60).cast("string"), F.lit("_"))
    edges = li.select(F.expr("l_orderkey div 1200").alias("archive_id"), node("l_partkey").alias("src"), node("l_suppkey").alias("dst")).where("src <> dst and substr(src, -2, 1) <> '7'").distinct()
    named = edges.select("archive_id", F.explode(F.array("src", "dst")).alias("name")).distinct()
    contents = edges.groupBy("archive_id", F.col("src").alias("name")).agg(F.concat_ws(" ", F.collect_list("dst")).alias("content"))
    entries = named.join(contents, ["archive_id", "name"], "left").select("archive_id", F.concat("name", F.lit(".class")).alias("source"), F.coalesce("content", F.lit("")).alias("content"))
    return G.reference_edges(entries).select("archive_id", F.btrim("src", F.lit("_")).alias("src"), F.btrim("dst", F.lit("_")).alias("dst"))


def x1_scan(spark, sf_dir):
    return J.scan(dealt(src.read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def _archives(spark, sf_dir):
    """Archives of eight documents each, written to the shared folder: every kind of member, with texts in several encodings and framings; a third have no known members."""
    docs = src.read(spark, sf_dir, "documents").select("doc_id", "text")
    turn = F.col("doc_id") % 8
    raw = F.encode("text", "utf-8")
    told = codecs.encoded(F.translate(F.lower("text"), LETTERS, HAN), F.lit("gb18030"))
    fields, _ = R.framed_mixed(src.lines(spark, sf_dir).where("doc_id % 8 = 2"))
    docs = docs.join(fields.withColumnRenamed("content", "fields"), "doc_id", "left")
    content = (
        F.when(turn == 1, F.encode("text", "UTF-16")).when(turn == 2, F.coalesce("fields", raw)).when(turn == 3, F.concat(F.unhex(F.lit("FF00")), raw, F.unhex(F.lit("00FF"))))
        .when(turn == 5, F.concat(F.unhex(F.lit("CAFEBABE0003")), raw)).when(turn == 7, told).otherwise(raw)
    )
    known, odd = (F.get(F.array(*[F.lit(x) for x in names]), turn.cast("int")) for names in (("txt", "properties", "bin", "dat", "odd", "class", "png", "lang"), ("odd", "odd", "odd", "class", "odd", "class", "png", "odd")))
    ext = F.when(F.expr("doc_id div 8 % 3") == 2, odd).otherwise(known)
    rows = docs.select(F.expr("doc_id div 8").alias("archive_id"), turn.alias("pos"), F.concat_ws("", F.lit("res/e"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("source"), content.alias("content"))
    return kept(archives.pack(rows), "archives")


def x1_archive_scan(spark, sf_dir):
    """The whole scan of archives: members, strings, candidates and counters of each archive."""
    entries = kept(archives.members(_archives(spark, sf_dir), lambda name, size: archives._reads(name, size, True)), "members")
    scan = A.scan_archives(entries)
    best = A.scan_candidates(scan.strings, entries).where("place = 1").select("archive_id", F.col("source").alias("best_source"), "source_type", "candidate_score")
    kinds = scan.strings.groupBy("archive_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), F.sum("score").cast("long").alias("score_sum"))
    return A.archive_diagnostics(entries, scan).join(kinds, "archive_id", "left").join(best, "archive_id", "left")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.isidentifier() and not f.__name__.startswith("_")}

ORACLE_SQL = {
    "e4_big5_runs": f"WITH {LINES}, t AS (SELECT doc_id, idx, translate(regexp_replace(lower(value), '[^a-z]', '', 'g'), '{LETTERS}', '{TRADITIONAL}') AS text FROM lines), p AS (SELECT doc_id, idx, unnest(range(0, length(text), 2048)) AS k, text AS t FROM t WHERE length(text) >= 2) SELECT doc_id, idx, (2 + 2 * k)::INT AS start, substr(t, k + 1, 2048) AS text FROM p WHERE length(substr(t, k + 1, 2048)) >= 2",
    "s1_pruned_entries": "SELECT page_id, page_id % 3 = 0 AND strlen(html) * 400 <= 16777216 AS fast, (page_id % 3 = 0 AND strlen(html) * 400 <= 16777216) OR (page_id % 3 <> 1 AND strlen(html) * 400 BETWEEN 1 AND 12582912) AS deep FROM pages",
    "s9_wide_rows": f"WITH {TRANSLATED} SELECT doc_id, idx, sha256(key) AS key_sha256, source, 'text' AS source_type, kind, 'utf-8' AS encoding, coalesce(translation, '') AS vietnamese FROM strings LEFT JOIN translations USING (key)",
    "s13_unsafe_members": "SELECT page_id, page_id % 4 < 2 AS unsafe FROM pages",
    "e4_legacy_runs": f"WITH {LINES}, t AS (SELECT doc_id, idx, translate(regexp_replace(lower(value), '[^a-z]', '', 'g'), '{LETTERS}', '{HAN}') AS text FROM lines), p AS (SELECT doc_id, idx, unnest(range(0, length(text), 2048)) AS k, text AS t FROM t WHERE length(text) >= 2) SELECT doc_id, idx, (2 + 2 * k)::INT AS start, substr(t, k + 1, 2048) AS text FROM p WHERE length(substr(t, k + 1, 2048)) >= 2",
    "s1_pruned_entries": "SELECT page_id, page_id % 3 = 0 AND strlen(html) * 400 <= 16777216 AS fast, (page_id % 3 = 0 AND strlen(html) * 400 <= 16777216) OR (page_id % 3 <> 1 AND strlen(html) * 400 BETWEEN 1 AND 12582912) AS deep FROM pages",
    "s9_wide_rows": f"WITH {TRANSLATED} SELECT doc_id, idx, sha256(key) AS key_sha256, source, 'text' AS source_type, kind, 'utf-8' AS encoding, coalesce(translation, '') AS vietnamese FROM strings LEFT JOIN translations USING (key)",
    "s13_unsafe_members": "SELECT page_id, page_id % 4 < 2 AS unsafe FROM pages",
    "e12_patch_safe": rf"WITH {LINES}, s AS (SELECT doc_id, idx % 4 <> 1 AND NOT regexp_matches(value, '[\x00-\x08\x0b\x0c\x0e-\x1f]') AND len(regexp_extract_all(value, '\p{{L}}')) >= 2 AS safe FROM lines) SELECT doc_id, count_if(safe) AS safe, count_if(NOT safe) AS unsafe FROM s GROUP BY doc_id",
    "e19_field_text": rf"WITH {LINES}, e AS (SELECT CASE WHEN idx % 4 = 0 AND regexp_matches(value, '\p{{L}}') THEN 'utf-8' WHEN idx % 4 = 1 THEN 'mixed-utf8' WHEN idx % 4 = 2 THEN 'gb18030' WHEN idx % 8 = 3 THEN 'latin-1' ELSE 'rejected' END AS encoding FROM lines) SELECT encoding, count(*) AS n FROM e GROUP BY encoding",
    "f10_entry_points": "SELECT DISTINCT m.o_orderkey % 40 AS archive_id, 'g.C' || (m.o_custkey % 30) AS root FROM orders m JOIN orders c ON c.o_orderkey % 40 = m.o_orderkey % 40 AND 'g.C' || (m.o_custkey % 30) = 'g.C' || (c.o_custkey % 7) WHERE m.o_orderkey % 20 < 10 AND c.o_orderkey % 20 < 10",
    "j7_reference_edges": f"WITH {EDGES} SELECT archive_id, src, dst FROM edges",
}
ORACLE_SQL |= {
    "s12_report_text": f"WITH {ACTED} SELECT archive_id, 'COMPATIBILITY REPORT' || chr(10) || 'compatibility_score: ' || compatibility_score || chr(10) || 'runtime_risk: ' || runtime_risk || chr(10) || 'startup_classification: ' || startup_classification || chr(10) || 'next_action: ' || {_NEXT} AS text FROM acts",
    "f12_startup_ranks": f"WITH {ASSESSED} SELECT archive_id, {_RANK('startup_classification')} AS rank FROM assessed",
}
ORACLE_SQL["a5_safe_counts"] = f"SELECT sum(safe)::BIGINT AS safe, sum(unsafe)::BIGINT AS unsafe FROM ({ORACLE_SQL['e12_patch_safe']})"
