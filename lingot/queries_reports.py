"""Queries over report texts, glyph gaps, profiles, findings, readiness, scan diagnostics and file gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import codecs
from .functions import constants as K
from .functions import text as T
from .operators import compat as C
from .operators import graph as G
from .operators import intervals as I
from .operators import memory as M
from .operators import scan as J
from .operators import strings as S
from .queries_compat import _COVERED, _CHARS, _NEXT, ACTED, APIS, ASSESSED, ENTRIES, FLOWS, RUNTIME, _assessed, _entries, _framed
from .queries_text import _RES, _ROWS, _STRIP, LINES, SCORED, WS, _rows
from .sources import archives
from .sources import tables as src


def j11_missing_glyphs(spark, sf_dir):
    """Characters of every document's translations that the font descriptor of English lacks."""
    letters = src.read(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where(F.col("ch").rlike(r"^\p{L}$")).distinct()
    ids = letters.select(F.concat(F.lit("char id="), F.conv(F.hex(F.encode("ch", "UTF-32")), 16, 10)).alias("line"))
    fonts = C.font_characters(ids.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text")).select(F.lit("en.fnt").alias("source"), "text"))
    rows = _rows(spark, sf_dir).select(F.col("doc_id").alias("grp"), "translation")
    return C.missing_glyphs(C.required_characters(rows), fonts)


def o3_profile_intersections(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    rows = C.runtime_reports(entries, C.detected_apis(entries)).select("archive_id", "detected_apis")
    profiles = F.explode(F.array(F.lit("freej2me_rg35xx"), F.lit("some_other_device"))).alias("profile")
    got = rows.select("archive_id", "detected_apis", profiles)
    return got.select("archive_id", "profile", *[F.array_join(C.profile_intersection(F.col("detected_apis"), F.col("profile"), s), "|").alias(s) for s in ("native", "conditional", "unsupported")])


def o4_suspicious_union(spark, sf_dir):
    """Given classes and those of the graph that are named after payment or activation, once each."""
    li = src.read(spark, sf_dir, "lineitem")
    archive = F.expr("l_orderkey div 1200").alias("archive_id")
    node = F.concat(F.when(F.col("l_suppkey") % 60 == 9, "g/PayDesk").otherwise("g/N"), (F.col("l_suppkey") % 60).cast("string"))
    given = li.where("l_linenumber = 7").select(archive, F.concat(F.lit("g/N"), (F.col("l_partkey") % 60).cast("string")).alias("node"))
    return G.suspicious_classes(given, li.select(archive, node.alias("node")))


def o5_detector_union(spark, sf_dir):
    """What the four detectors agree on: strongest fields of every content by framing."""
    got = I.strongest_fields(_framed(spark, sf_dir))
    return got.groupBy("doc_id", "framing").agg(F.count(F.lit(1)).alias("fields"), F.count_if("safe").alias("safe"), F.max("confidence").alias("confidence"))


def t5_bounded_lists(spark, sf_dir):
    """The bounded lists of a report's messages: five classes, three sources of an API, and characters cut at 140."""
    entries = _entries(spark, sf_dir)
    classes = C.flow_terms(entries).where("is_class").groupBy("archive_id").agg(F.array_sort(F.collect_set("source")).alias("classes"))
    chars = entries.groupBy("archive_id").agg(F.array_sort(F.collect_set(F.lower("content"))).alias("contents"))
    rows = chars.join(classes, "archive_id", "left")
    glyphs = F.array_sort(F.array_distinct(F.split(F.array_join("contents", ""), "")))
    return rows.select("archive_id", C.bounded("classes", 5, "no named class").alias("classes"), C.bounded("contents", 3).alias("contents"), C.cut(F.array_join(F.filter(glyphs, lambda c: c != ""), " "), 40).alias("glyphs"))


def f11_report_summaries(spark, sf_dir):
    return C.diagnostic_summaries(_assessed(spark, sf_dir).withColumn("name", F.concat(F.lit("a"), F.col("archive_id").cast("string"), F.lit(".jar")))).select("archive_id", "action_label", "summary")


def a2_scan_diagnostics(spark, sf_dir):
    ext = F.get(F.array(*[F.lit(x) for x in (".txt", ".png", ".odd", ".class", ".txt")]), (F.col("doc_id") % 5).cast("int"))
    docs = src.read(spark, sf_dir, "documents")
    entries = docs.select(F.col("source").alias("archive_id"), F.concat(F.lit("e"), F.col("doc_id").cast("string"), ext).alias("source"), F.octet_length("text").alias("size"), "text")
    return J.scan_diagnostics(entries)


def a6_build_readiness(spark, sf_dir):
    """Readiness of every archive from all producers of issues; one in eleven has no strings, some no translations."""
    strings = _entries(spark, sf_dir).where("archive_id % 11 <> 0").groupBy("archive_id").agg(F.count(F.lit(1)).alias("strings"), F.count_if((F.col("archive_id") % 7 > 0) & ~F.col("source").endswith(".fnt")).alias("translated"), F.count_if(F.col("source").endswith(".fnt")).alias("unsafe"))
    rows = _assessed(spark, sf_dir).join(strings, "archive_id", "left")
    risks = C.font_risk(_entries(spark, sf_dir)).select("archive_id", "font_risk")
    rows = rows.join(risks, "archive_id").withColumn("overall_risk", C.overall_risk(F.col("font_risk"), F.col("runtime_risk"), F.lit("low")))
    return C.readiness(C.readiness_issues(rows), rows)


def a17_all_findings(spark, sf_dir):
    """Findings of the runtime, activation and encoding analyzers."""
    entries = _entries(spark, sf_dir)
    reports = _assessed(spark, sf_dir)
    texts = entries.where(F.col("source").endswith(".txt")).select("archive_id", "source", F.when(F.col("archive_id") % 2 == 0, "cp1252").otherwise("utf-8").alias("codec"), F.concat(F.lit("dịch "), "content").alias("translation"))
    found = C.findings(reports).unionByName(C.activation_findings(reports.withColumn("has_roots", F.col("archive_id") % 3 == 0))).unionByName(C.encoding_findings(entries, texts))
    return found.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("archive_id").alias("archives"))


def p11_target_charsets(spark, sf_dir):
    """Whether every document can be written in the charset of its language."""
    charset = F.when(F.col("lang") == "en", "ascii").when(F.col("lang") == "de", "latin-1").when(F.col("lang") == "fr", "cp1252").otherwise("utf-8")
    docs = src.read(spark, sf_dir, "documents").select("doc_id", charset.alias("charset"), F.concat("text", F.when(F.col("doc_id") % 4 == 0, "€").when(F.col("doc_id") % 4 == 1, "ế").otherwise("")).alias("text"))
    return docs.select("doc_id", "charset", codecs.encodable("text", "charset").alias("encodable"))


def s12_report_pairs(spark, sf_dir):
    """The JSON half of the report pair beside the length of its text."""
    pair = J.report_pair(_assessed(spark, sf_dir), "COMPATIBILITY REPORT", ["compatibility_score", "runtime_risk", "startup_classification", "next_action"])
    return pair.select("archive_id", "json", F.char_length("text").cast("long").alias("chars"))


def s13_bundles(spark, sf_dir):
    """Bundles told by orders: known members, logs, unsafe and too many ones."""
    o = src.read(spark, sf_dir, "orders")
    name = F.get(F.array(*[F.lit(x) for x in ("bundle_manifest.json", "runtime_diagnosis.json", "logs/run.log", "notes.md", "compatibility_report.json")]), (F.col("o_orderkey") % 5).cast("int"))
    source = F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("../"), name)).otherwise(F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit("/"), name))
    content = F.when(F.col("o_orderkey") % 10 == 0, "{broken").otherwise(F.concat(F.lit('{"a": '), F.col("o_orderkey").cast("string"), F.lit("}")))
    members = o.select(F.expr("o_custkey div 3").alias("archive_id"), source.alias("source"), F.lit(10).cast("long").alias("size"), F.encode(content, "utf-8").alias("content"))
    # of several members of one name the bundle keeps the greatest text, so only whether there is one is told
    got = archives.inspect_bundles(members, most_entries=40)
    return got.select("archive_id", F.col("n").alias("members"), "rejected", F.col("manifest").isNotNull().alias("manifest"), F.col("diagnosis").isNotNull().alias("diagnosis"), F.col("report").isNotNull().alias("report"), "log_source")


def x3_file_gates(spark, sf_dir):
    """The first gate that every exchange file fails; one file for each document, with faults by its number."""
    turn = F.col("doc_id") % 10
    sha = F.sha2("text", 256)
    name = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(".jar"))
    items = F.split("text", "\n")
    files = src.read(spark, sf_dir, "documents").select(
        "doc_id", F.when(turn == 1, 1).otherwise(2).alias("schema_version"), F.when(turn == 2, None).when(turn == 3, "b.jar").otherwise(name).alias("source_name"),
        F.when(turn == 4, "0").otherwise(sha).alias("source_sha256"), (turn != 5).alias("has_protocol"), (turn != 6).alias("has_contract"),
        F.when(turn == 7, None).otherwise(items).alias("items"), (F.size(items) + F.when(turn == 8, 1).otherwise(0)).alias("item_count"),
    )
    known = src.read(spark, sf_dir, "documents").select(name.alias("source_name"), sha.alias("sha256"))
    return M.file_gates(files, known).select("doc_id", "gate")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.isidentifier() and not f.__name__.startswith("_")}

_AFTER = "CASE WHEN contains(line, '=') THEN " + _STRIP("substr(line, strpos(line, '=') + 1)") + " ELSE line END"
_PAIRED = "CASE WHEN contains(line, '=') THEN coalesce(nullif(" + _STRIP("substr(line, strpos(line, '=') + 1)") + ", ''), line) WHEN contains(line, ':') AND strpos(line, ':') - 1 < 40 THEN coalesce(nullif(" + _STRIP("substr(line, strpos(line, ':') + 1)") + ", ''), line) ELSE line END"
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_HUMAN = lambda s: (
    rf"(length({s}) BETWEEN 2 AND 800 AND regexp_matches({s}, '\p{{L}}') AND NOT (length({s}) > 12 AND regexp_matches({s}, '^[A-Za-z0-9_/$.;<>\[\]():+-]+$') AND (contains({s}, '/') OR contains({s}, ';') OR {_COUNT(s, '[.]')} >= 2))"
    rf" AND {_COUNT(s, r'[^\p{C}\p{Zl}\p{Zp}\p{Zs}]|[ \t\r\n]')} / length({s}) * 0.55 + {_COUNT(s, r'\p{L}')} / length({s}) * 0.55 - {_COUNT(s, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')} * 0.2 >= 0.55)"
)


def _passes(entries: str, fast: str, deep: str) -> str:
    """lines of the fast and the deep pass over entries(doc_id, archive_id, source, text)."""
    return rf"""{entries}, raw AS (SELECT doc_id, archive_id, source, unnest(range(len(p)))::INT AS idx, unnest(p) AS v FROM (SELECT *, string_split_regex(text, '\r\n|\r|\n') AS p FROM ents)),
        res AS (SELECT * FROM (SELECT doc_id, archive_id, source, idx, {_STRIP('v')} AS line FROM raw) WHERE line <> '' AND NOT regexp_matches(line, '^(?:#|;|//)')),
        lines AS (SELECT * FROM (SELECT doc_id, archive_id, source, idx, {_AFTER} AS value, 'resource-text' AS kind FROM res WHERE {fast}) WHERE value <> ''
        UNION ALL SELECT * FROM (SELECT doc_id, archive_id, source, idx, {_PAIRED} AS value, 'deep-text' AS kind FROM res WHERE {deep}) WHERE {_HUMAN('trim(value)')})"""


_JUDGED = "judged AS (SELECT *, s <> '' AND CASE kind WHEN 'deep-text' THEN score - 8 >= 18 ELSE score >= 14 END AS good, CASE WHEN score > -100 AND kind = 'deep-text' THEN score - 8 ELSE score END AS points FROM scored)"
_SCAN_ENTRIES = "ents AS (SELECT doc_id, source AS archive_id, 'e' || doc_id || (['.txt', '.png', '.odd', '.class', '.txt'])[(doc_id % 5 + 1)::INT] AS source, text, strlen(text) AS size FROM documents)"
_NOT_CP1252 = r"[^\x00-\x7f\x{a0}-\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_SETS = lambda f: "CASE profile " + " ".join(f"WHEN '{p}' THEN list_filter(detected_apis, lambda x: x IN ({', '.join(repr(a) for a in kinds[f])}))" for p, kinds in (("freej2me_rg35xx", K.PROFILES["freej2me_rg35xx"]), ("some_other_device", K.PROFILES["generic_j2me"]))) + " END"
_TITLE = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.STARTUP_TITLES.items()) + " END"
_NONE = lambda c: f"coalesce(nullif(array_to_string({c}, ', '), ''), 'none')"
_NL = " || chr(10) || "

ORACLE_SQL = {
    "j11_missing_glyphs": f"WITH {_ROWS}, typed AS (SELECT DISTINCT doc_id AS grp, ch FROM (SELECT doc_id, unnest(string_split(translation, '')) AS ch FROM rows WHERE translation IS NOT NULL) WHERE ch <> '' AND NOT regexp_matches(ch, '{WS}')), req AS (SELECT * FROM typed UNION SELECT doc_id, unnest(string_split('{K.VIETNAMESE}', '')) FROM (SELECT DISTINCT doc_id FROM rows) WHERE doc_id NOT IN (SELECT grp FROM typed)), mapped AS (SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE lang = 'en') WHERE regexp_full_match(ch, '\\p{{L}}')) SELECT grp, ch FROM req WHERE ch NOT IN (SELECT ch FROM mapped)",
    "o3_profile_intersections": f"WITH {RUNTIME} SELECT archive_id, profile, array_to_string({_SETS('native')}, '|') AS native, array_to_string({_SETS('conditional')}, '|') AS conditional, array_to_string({_SETS('unsupported')}, '|') AS unsupported FROM runtime, (SELECT unnest(['freej2me_rg35xx', 'some_other_device']) AS profile)",
    "o4_suspicious_union": "SELECT l_orderkey // 1200 AS archive_id, 'g/N' || (l_partkey % 60) AS node FROM lineitem WHERE l_linenumber = 7 UNION SELECT l_orderkey // 1200, 'g/PayDesk9' FROM lineitem WHERE l_suppkey % 60 = 9",
    "t5_bounded_lists": f"""WITH {ENTRIES}{FLOWS}, c AS (SELECT archive_id, list_sort(list(DISTINCT source)) AS classes FROM flows WHERE is_class AND len(terms) > 0 GROUP BY archive_id), t AS (SELECT archive_id, list_sort(list(DISTINCT lower(content))) AS contents FROM entries GROUP BY archive_id),
        g AS (SELECT *, array_to_string(list_sort(list_filter(list_distinct(string_split(array_to_string(contents, ''), '')), lambda x: x <> '')), ' ') AS glyphs FROM t)
        SELECT archive_id, coalesce(array_to_string(classes[1:5], ', '), 'no named class') AS classes, array_to_string(contents[1:3], ', ') AS contents, CASE WHEN length(glyphs) > 40 THEN substr(glyphs, 1, 40) || '...' ELSE glyphs END AS glyphs FROM g LEFT JOIN c USING (archive_id)""",
    "f11_report_summaries": f"WITH {ACTED} SELECT archive_id, {_NEXT.replace('category', _TITLE('category').replace('CASE category', 'CASE category'))} AS action_label, 'JAR RG35XX DIAGNOSTIC SUMMARY'{_NL}'JAR: a' || archive_id || '.jar'{_NL}'Target: FreeJ2ME / RG35XX'{_NL}'Runtime: ' || compatibility_score || '/100 · ' || upper(runtime_risk){_NL}'Assessment: ' || {_TITLE('startup_classification')} || ' · ' || upper(CASE WHEN startup_classification = 'runtime_only_incompatibility' AND len(unsupported) > 0 THEN 'high' WHEN startup_classification = 'compatible_or_unknown' THEN 'low' ELSE 'medium' END){_NL}'Detected APIs: ' || {_NONE('detected_apis')}{_NL}'Unsupported APIs: ' || {_NONE('unsupported')}{_NL}'Conditional APIs: ' || {_NONE('conditional')}{_NL}'Startup path: not found'{_NL}'Next action: ' || {_NEXT.replace('category', _TITLE('category'))} AS summary FROM acts",
    "a2_scan_diagnostics": f"""WITH {SCORED.replace(LINES, _passes(_SCAN_ENTRIES, "source LIKE '%.txt'", "source LIKE '%.odd' AND source IN (SELECT source FROM ents WHERE size > 0)"))}, {_JUDGED},
        said AS (SELECT archive_id, source, s, count(*) AS n, count_if(good) AS ok, count_if(kind = 'deep-text') AS deep FROM judged GROUP BY ALL),
        sums AS (SELECT archive_id, sum(n) AS n, sum(ok) AS ok, count_if(ok > 0) AS total, sum(deep) AS deep, count(DISTINCT source) FILTER (ok > 0) AS candidates FROM said GROUP BY archive_id)
        SELECT e.archive_id, count(*) AS entries_total, count_if(source NOT LIKE '%.png' AND NOT (source LIKE '%.odd' AND size = 0)) AS entries_read, count_if(source LIKE '%.odd' AND size > 0) AS entries_deep_scanned, count_if(source LIKE '%.png' OR (source LIKE '%.odd' AND size = 0)) AS entries_skipped_media_or_size, count_if(source LIKE '%.class') AS class_parse_failed,
        coalesce(any_value(n), 0)::BIGINT AS strings_before_filter, coalesce(any_value(total), 0)::BIGINT AS strings_after_filter, coalesce(any_value(n) - any_value(ok), 0)::BIGINT AS strings_rejected_non_language, coalesce(any_value(deep), 0)::BIGINT AS deep_strings, coalesce(any_value(candidates), 0)::BIGINT AS candidates, coalesce(any_value(total), 0)::BIGINT AS total_strings
        FROM ents e LEFT JOIN sums USING (archive_id) GROUP BY e.archive_id""",
    "x1_scan": f"""WITH {SCORED.replace(LINES, _passes("ents AS (SELECT doc_id, source AS archive_id, source, text FROM documents)", "TRUE", "TRUE"))}, {_JUDGED},
        firsts AS (SELECT * FROM judged WHERE good QUALIFY row_number() OVER (PARTITION BY doc_id, kind, s ORDER BY idx) = 1), enough AS (SELECT doc_id FROM firsts WHERE kind = 'resource-text' GROUP BY doc_id HAVING count(*) >= 5)
        SELECT doc_id, kind, count(*) AS n, max(points)::INT AS best FROM firsts WHERE (kind = 'resource-text') = (doc_id IN (SELECT doc_id FROM enough)) GROUP BY doc_id, kind""",
    "a6_build_readiness": f"""WITH {ACTED}, fonts AS (SELECT archive_id, count_if(source LIKE '%.fnt') AS fnt, count(*) AS n FROM entries GROUP BY archive_id),
        told AS (SELECT a.*, fnt, CASE WHEN a.archive_id % 11 = 0 THEN 0 ELSE n END AS strings, CASE WHEN a.archive_id % 11 = 0 OR a.archive_id % 7 = 0 THEN 0 ELSE n - fnt END AS translated, CASE WHEN a.archive_id % 11 = 0 THEN 0 ELSE fnt END AS unsafe, CASE WHEN fnt > 0 OR runtime_risk = 'high' THEN 'high' WHEN runtime_risk = 'medium' THEN 'medium' ELSE 'low' END AS overall FROM acts a JOIN fonts USING (archive_id)),
        levels AS (SELECT archive_id, [CASE WHEN strings = 0 OR translated = 0 THEN 2 WHEN translated < strings THEN 1 ELSE 0 END, CASE WHEN unsafe > 0 THEN 1 END, CASE WHEN overall IN ('high', 'medium') THEN 1 ELSE 0 END, CASE WHEN len(unsupported) > 0 THEN 1 END, CASE WHEN len(conditional) > 0 THEN 1 END, CASE WHEN len(unsupported) > 0 OR len(conditional) > 0 THEN 1 ELSE 0 END,
        CASE WHEN list_contains(detected_apis, 'wma_sms') THEN 1 END, CASE WHEN flow_risk <> 'low' THEN 1 ELSE 0 END, CASE WHEN startup_classification <> 'compatible_or_unknown' THEN 1 ELSE 0 END, CASE WHEN priority <= 2 THEN 1 ELSE 0 END] AS l FROM told)
        SELECT archive_id, len(list_filter(l, lambda x: x IS NOT NULL))::BIGINT AS issues, (['READY', 'WARNING', 'BLOCKED'])[list_max(l) + 1] AS status FROM levels""",
    "a17_all_findings": f"""WITH {ASSESSED}, enc AS (SELECT archive_id, source, content FROM entries WHERE source LIKE '%.txt'), marked AS (SELECT DISTINCT archive_id, source FROM enc WHERE regexp_matches(lower(content), 'utf-8|utf8|unicode|charset|glyph')),
        f AS (SELECT archive_id, unnest(detected_apis) AS category, NULL AS severity FROM runtime UNION ALL SELECT archive_id, 'wma_policy', 'medium' FROM runtime WHERE list_contains(detected_apis, 'wma_sms') UNION ALL SELECT archive_id, 'runtime', 'low' FROM runtime WHERE len(detected_apis) = 0
        UNION ALL SELECT archive_id, 'activation', flow_risk FROM assessed WHERE classes > 0 UNION ALL SELECT archive_id, 'wma_link', 'high' FROM assessed WHERE wma_linked UNION ALL SELECT archive_id, 'startup_path', 'medium' FROM assessed WHERE classes > 0 AND archive_id % 3 = 0
        UNION ALL SELECT archive_id, 'encoding', 'low' FROM marked UNION ALL SELECT archive_id, 'encoding', 'high' FROM enc WHERE archive_id % 2 = 0
        UNION ALL SELECT DISTINCT archive_id, 'encoding', 'medium' FROM enc WHERE archive_id % 2 = 1 AND archive_id NOT IN (SELECT archive_id FROM marked))
        SELECT category, coalesce(severity, CASE WHEN category = 'media' THEN 'low' WHEN category IN ('m3g', 'bluetooth', 'file_connection') THEN 'medium' ELSE 'high' END) AS severity, count(*) AS n, count(DISTINCT archive_id) AS archives FROM f GROUP BY 1, 2""",
    "p11_target_charsets": rf"SELECT doc_id, CASE lang WHEN 'en' THEN 'ascii' WHEN 'de' THEN 'latin-1' WHEN 'fr' THEN 'cp1252' ELSE 'utf-8' END AS charset, CASE lang WHEN 'en' THEN NOT regexp_matches(t, '[^\x00-\x7f]') WHEN 'de' THEN NOT regexp_matches(t, '[^\x00-\x{{ff}}]') WHEN 'fr' THEN NOT regexp_matches(t, '{_NOT_CP1252}') ELSE TRUE END AS encodable FROM (SELECT doc_id, lang, text || CASE doc_id % 4 WHEN 0 THEN '€' WHEN 1 THEN 'ế' ELSE '' END AS t FROM documents)",
    "s12_report_pairs": f"WITH {ACTED} SELECT archive_id, '{{\"compatibility_score\":' || compatibility_score || ',\"runtime_risk\":\"' || runtime_risk || '\",\"startup_classification\":\"' || startup_classification || '\",\"next_action\":\"' || {_NEXT} || '\"}}' AS json, length('COMPATIBILITY REPORT' || '1compatibility_score: ' || compatibility_score || '1runtime_risk: ' || runtime_risk || '1startup_classification: ' || startup_classification || '1next_action: ' || {_NEXT}) AS chars FROM acts",
    "s13_bundles": """WITH m AS (SELECT o_custkey // 3 AS archive_id, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 97 = 0 THEN '../' ELSE 'd' || o_orderkey || '/' END || (['bundle_manifest.json', 'runtime_diagnosis.json', 'logs/run.log', 'notes.md', 'compatibility_report.json'])[(o_orderkey % 5 + 1)::INT] AS source FROM orders)
        SELECT archive_id, count(*) AS members, CASE WHEN count(*) > 40 THEN 'too many entries' WHEN bool_or(source LIKE '../%') THEN 'unsafe path' END AS rejected, bool_or(k = 0) AS manifest, bool_or(k = 1) AS diagnosis, bool_or(k = 4) AS report, min(source) FILTER (k = 2) AS log_source FROM m GROUP BY archive_id""",
    "x3_file_gates": "SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'schema_version' WHEN 2 THEN 'source_block' WHEN 3 THEN 'archive_name' WHEN 4 THEN 'archive_hash' WHEN 5 THEN 'protocol' WHEN 6 THEN 'contract' WHEN 7 THEN 'items' WHEN 8 THEN 'item_count' END AS gate FROM documents",
}
