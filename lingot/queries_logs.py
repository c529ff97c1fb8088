"""Queries over runtime logs (events told as log lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import constants as K
from .operators import logs as L
from .sources import tables as src

LOG = r"""log AS (SELECT user_id AS log_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS line_no, ts,
    CASE event_id % 7 WHEN 0 THEN 'java.lang.NullPointerException: ' || event_type WHEN 1 THEN '    at com.game.Scene' || (event_id % 5) || '.run(Scene.java:1)'
    WHEN 2 THEN 'Caused by: java.lang.ClassNotFoundException: javax/bluetooth/' || event_type WHEN 3 THEN '    at javax.microedition.media.Player' || (event_id % 3) || '.start(Player.java:2)'
    WHEN 4 THEN 'WARNING: could be slow in res/' || event_type || '.png' ELSE 'info ' || event_type END AS line FROM events)"""
_RULE = lambda i: "CASE " + " ".join(f"WHEN contains(lower(trim(line)), '{r[0].lower()}') THEN '{r[i]}'" for r in K.LOG_RULES) + " " + " ".join(f"WHEN contains(lower(trim(line)), '{w}') THEN '{('runtime-failure', 'HIGH', 'runtime')[i]}'" for w in K.FAILURE_WORDS) + " " + " ".join(f"WHEN contains(lower(trim(line)), '{w}') THEN '{('warning', 'MEDIUM', 'runtime')[i]}'" for w in K.WARNING_WORDS) + " END"
ISSUES = LOG + rf""", issues AS (SELECT *, replace(regexp_extract(line, '{K.CLASS_IN_LOG}', 1), '.', '/') AS class_name, regexp_replace(replace(regexp_extract(line, '{K.RESOURCE_IN_LOG}', 1), '\', '/'), '^/+', '') AS resource
    FROM (SELECT *, {_RULE(0)} AS token, {_RULE(1)} AS severity, {_RULE(2)} AS category FROM log) WHERE token IS NOT NULL)"""
_TYPES = "(" + ", ".join(f"'{t}'" for t in K.ERROR_TYPES) + ")"
_TYPE = "CASE " + " ".join(f"WHEN contains(line, '{t}') THEN '{t}'" for t in K.ERROR_TYPES) + " END"
_SEVERE = "(" + ", ".join(f"'{t}'" for t in K.SEVERE_TYPES) + ")"
_HINT = lambda c: "CASE " + " ".join(f"WHEN contains(lower(replace({c}, '/', '.')), '{p}') THEN '{a}'" for p, a in K.API_HINTS) + " ELSE '' END"
_TAIL = "ltrim(substr(trim(line), strpos(trim(line), error_type) + length(error_type)), ': ')"
EVENTS = LOG + rf""", marked AS (SELECT *, {_TYPE} AS error_type FROM log), numbered AS (SELECT *, sum(CASE WHEN error_type IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY line_no) - 1 AS event FROM marked),
    heads AS (SELECT log_id, event::INT AS event, error_type, {_TAIL} AS message, trim(line) LIKE 'Caused by:%' AS caused_by FROM numbered WHERE error_type IS NOT NULL),
    frames AS (SELECT log_id, event::INT AS event, regexp_extract(line, '{K.STACK_FRAME}', 1) AS frame, min(line_no) AS seen_at FROM numbered WHERE error_type IS NULL AND event >= 0 AND regexp_extract(line, '{K.STACK_FRAME}', 1) <> '' GROUP BY ALL),
    events2 AS (SELECT h.*, coalesce((SELECT list(frame ORDER BY seen_at) FROM frames f WHERE f.log_id = h.log_id AND f.event = h.event), []) AS frames, CASE WHEN error_type IN {_SEVERE} THEN 'high' ELSE 'medium' END AS severity FROM heads h)"""
REPORTS = ", reports AS (SELECT DISTINCT user_id AS log_id, ['com/game/Scene1', 'com/game/Scene3'] AS startup_path, CASE WHEN user_id % 2 = 0 THEN ['bluetooth', 'media'] ELSE [] END AS detected_apis FROM events)"
SCORED_EVENTS = EVENTS + REPORTS + rf""", overlapping AS (SELECT e.*, list_filter(['com.game.Scene1', 'com.game.Scene3'], lambda x: list_contains(frames, x)) AS startup_overlap,
    CASE WHEN list_contains(r.detected_apis, {_HINT("message || ' ' || array_to_string(frames, ' ')")}) THEN 1 ELSE 0 END AS api_hits FROM events2 e JOIN reports r USING (log_id)),
    scored AS (SELECT *, (CASE WHEN caused_by THEN 100 ELSE 0 END + CASE severity WHEN 'high' THEN 60 ELSE 20 END + 25 * len(startup_overlap) + 20 * api_hits + event)::INT AS score FROM overlapping)"""
TIMELINE = SCORED_EVENTS + """, timeline AS (SELECT log_id, coalesce(max(CASE WHEN caused_by THEN event END), 0) AS root_event, arg_max(event, score * 100000 - event) AS primary_event, arg_max(error_type, score * 100000 - event) AS primary_exception,
    arg_max(startup_overlap, score * 100000 - event) AS primary_startup, count(*)::INT AS exceptions, count_if(severity = 'high')::INT AS high FROM scored GROUP BY log_id)"""
FINDINGS = rf"""found AS (SELECT log_id, error_type, symbol, line, min(line_no) AS line_no, {_HINT("line || ' ' || symbol")} AS api_hint, CASE WHEN error_type IN {_SEVERE} THEN 'high' ELSE 'medium' END AS severity
    FROM (SELECT log_id, line_no, trim(line) AS line, error_type, replace(regexp_extract({_TAIL}, '^([^\s;,]*)', 1), '/', '.') AS symbol FROM log, (SELECT unnest({_TYPES.replace("(", "[").replace(")", "]")}) AS error_type) WHERE contains(line, error_type)) GROUP BY ALL)"""
_POS = f"list_position({_TYPES.replace('(', '[').replace(')', ']')}, error_type)"
CORRELATED = FINDINGS + rf""", sums AS (SELECT log_id, count(*)::INT AS findings, list_sort(list(DISTINCT api_hint) FILTER (api_hint <> '')) AS hints, bool_or(error_type IN ('ClassNotFoundException', 'NoClassDefFoundError')) AS missing,
    arg_min(symbol, line_no * 10 + {_POS}) FILTER (error_type IN ('ClassNotFoundException', 'NoClassDefFoundError') AND symbol <> '') AS missing_symbol, arg_min(error_type, line_no * 10 + {_POS}) AS first_type FROM found GROUP BY log_id),
    all_frames AS (SELECT log_id, list(frame ORDER BY seen_at) AS frames FROM (SELECT log_id, regexp_extract(line, '{K.STACK_FRAME}', 1) AS frame, min(line_no) AS seen_at FROM log WHERE regexp_extract(line, '{K.STACK_FRAME}', 1) <> '' GROUP BY ALL) GROUP BY log_id),
    correlated AS (SELECT l.log_id, coalesce(findings, 0)::INT AS findings, coalesce(frames, []) AS frames, CASE WHEN len(r.detected_apis) = 0 THEN coalesce(hints, []) ELSE list_filter(coalesce(hints, []), lambda x: list_contains(r.detected_apis, x)) END AS matched_apis,
    list_filter(['com.game.Scene1', 'com.game.Scene3'], lambda x: list_contains(coalesce(frames, []), x)) AS matched_startup,
    CASE WHEN missing THEN 'Runtime cannot resolve required class: ' || coalesce(missing_symbol, 'required class') WHEN findings > 0 THEN 'Runtime exception detected: ' || first_type ELSE 'No high-confidence runtime failure detected' END AS probable_cause
    FROM (SELECT DISTINCT log_id FROM log) l LEFT JOIN sums USING (log_id) LEFT JOIN all_frames USING (log_id) LEFT JOIN reports r USING (log_id)),
    pathed AS (SELECT *, list_concat(matched_startup, list_filter(list_reverse(frames), lambda x: NOT regexp_matches(x, '^(?:java|javax|sun|com\.sun)\.') AND NOT list_contains(matched_startup, x)), matched_apis[1:1]) AS failing_path FROM correlated)"""


def _reports(spark, sf_dir):
    users = src.read(spark, sf_dir, "events").select(F.col("user_id").alias("log_id")).distinct()
    apis = F.when(F.col("log_id") % 2 == 0, F.array(F.lit("bluetooth"), F.lit("media"))).otherwise(F.array().cast("array<string>"))
    return users.withColumns({"startup_path": F.array(F.lit("com/game/Scene1"), F.lit("com/game/Scene3")), "detected_apis": apis})


def _issues(spark, sf_dir):
    return L.classify_lines(src.log_lines(spark, sf_dir))


def s5_log_lines(spark, sf_dir):
    return src.log_lines(spark, sf_dir).select("log_id", "line_no", "line")


def s6_patched_sources(spark, sf_dir):
    """Paths of items with status PATCHED of JSON build reports (here: one report for a thousand order keys)."""
    from .sources.exchange import patched_paths

    orders = src.read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 100 == 0, "PATCHED").otherwise("SKIPPED")
    item = F.struct(F.concat(F.lit("\\res\\"), F.col("o_orderkey").cast("string"), F.lit(".dat")).alias("source"), status.alias("status"))
    reports = orders.groupBy(F.expr("o_orderkey div 1000")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json"))
    return patched_paths(reports, "json")


def f7_log_names(spark, sf_dir):
    log = src.log_lines(spark, sf_dir)
    return log.select("log_id", "line_no", L.stack_frame(F.col("line")).alias("frame"), F.regexp_extract("line", K.CLASS_IN_LOG, 1).alias("class"), F.regexp_extract("line", K.RESOURCE_IN_LOG, 1).alias("resource"))


def f8_symbols_and_hints(spark, sf_dir):
    log = src.log_lines(spark, sf_dir).withColumn("error_type", L.error_type(F.col("line"))).where("error_type is not null")
    return log.select("log_id", "line_no", "error_type", L.symbol(F.trim("line"), F.col("error_type")).alias("symbol"), L.api_hint(F.col("line")).alias("api"))


def w8_exception_events(spark, sf_dir):
    e = L.events(src.log_lines(spark, sf_dir))
    return e.select("log_id", "event", "error_type", "message", "caused_by", F.array_join("frames", "|").alias("frames"), "severity")


def w9_root_and_primary(spark, sf_dir):
    told = L.timeline(L.scored_events(L.events(src.log_lines(spark, sf_dir)), _reports(spark, sf_dir)))
    return told.select("log_id", "root_event", "primary_event", "primary_exception", F.array_join("primary_startup", "|").alias("primary_startup"), "exceptions", "high")


def w10_distinct_findings(spark, sf_dir):
    return L.findings(src.log_lines(spark, sf_dir)).select("log_id", "line_no", "error_type", "symbol", "api_hint", "severity")


def w11_history(spark, sf_dir):
    """Per user the ten newest diagnoses, one for each report path (here: event type and its props)."""
    e = src.read(spark, sf_dir, "events").select("user_id", "event_type", "props", "ts", "event_id")
    return L.history(e, "user_id", ["event_type", "props"], ["ts", "event_id"]).select("user_id", "place", "event_id")


def w12_first_rule(spark, sf_dir):
    return _issues(spark, sf_dir).select("log_id", "line_no", "token", "severity", "category", "class_name", "resource")


def j9_patched_lines(spark, sf_dir):
    """Log issues that name a patched source: the resources of all event types."""
    sources = src.read(spark, sf_dir, "events").select(F.concat(F.lit("assets/res/"), F.col("event_type"), F.lit(".png")).alias("path")).distinct()
    return L.patched_sources(_issues(spark, sf_dir), sources).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("log_id").alias("logs"))


def j10_startup_overlap(spark, sf_dir):
    scored = L.scored_events(L.events(src.log_lines(spark, sf_dir)), _reports(spark, sf_dir))
    return scored.where(F.size("startup_overlap") > 0).select("log_id", "event", F.array_join("startup_overlap", "|").alias("startup_overlap"), "score")


def a14_log_frequencies(spark, sf_dir):
    return L.frequencies(_issues(spark, sf_dir))


def a15_log_status(spark, sf_dir):
    return L.log_status(_issues(spark, sf_dir))


def x16_correlation(spark, sf_dir):
    found = L.correlate(src.log_lines(spark, sf_dir), _reports(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, "|") for c in ("frames", "matched_apis", "matched_startup", "failing_path")})


def x17_diagnosis(spark, sf_dir):
    found = L.diagnose(src.log_lines(spark, sf_dir), _reports(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, "|") for c in ("matched_apis", "startup_overlap", "failing_path")})


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.isidentifier() and not f.__name__.startswith("_")}
QUERIES["a16_diagnosis_summary"] = lambda spark, sf_dir: x17_diagnosis(spark, sf_dir).groupBy("probable_cause", "primary_exception").agg(F.count(F.lit(1)).alias("logs"), F.sum("exceptions").alias("exceptions"))
QUERIES["o6_matched_apis"] = lambda spark, sf_dir: x16_correlation(spark, sf_dir).select("log_id", "matched_apis")

_J = lambda *cols: ", ".join(f"array_to_string({c}, '|') AS {c}" for c in cols)
_X17 = f"""SELECT p.log_id, probable_cause, coalesce(primary_exception, 'none') AS primary_exception, coalesce((SELECT error_type FROM heads h WHERE h.log_id = p.log_id AND h.event = t.root_event), 'none') AS root_exception,
    array_to_string(failing_path, '|') AS failing_path, array_to_string(matched_apis, '|') AS matched_apis, array_to_string(CASE WHEN len(coalesce(primary_startup, [])) > 0 THEN primary_startup ELSE matched_startup END, '|') AS startup_overlap,
    coalesce(exceptions, 0) AS exceptions, coalesce(high, 0) AS high FROM pathed p LEFT JOIN timeline t USING (log_id)"""
ORACLE_SQL = {
    "s5_log_lines": f"WITH {LOG} SELECT log_id, line_no, line FROM log",
    "s6_patched_sources": "SELECT DISTINCT 'res/' || o_orderkey || '.dat' AS path FROM orders WHERE o_orderkey % 100 = 0",
    "f7_log_names": f"WITH {LOG} SELECT log_id, line_no, regexp_extract(line, '{K.STACK_FRAME}', 1) AS frame, regexp_extract(line, '{K.CLASS_IN_LOG}', 1) AS class, regexp_extract(line, '{K.RESOURCE_IN_LOG}', 1) AS resource FROM log",
    "f8_symbols_and_hints": rf"WITH {LOG} SELECT log_id, line_no, error_type, replace(regexp_extract({_TAIL}, '^([^\s;,]*)', 1), '/', '.') AS symbol, {_HINT('line')} AS api FROM (SELECT *, {_TYPE} AS error_type FROM log) WHERE error_type IS NOT NULL",
    "w8_exception_events": f"WITH {EVENTS} SELECT log_id, event, error_type, message, caused_by, array_to_string(frames, '|') AS frames, severity FROM events2",
    "w9_root_and_primary": f"WITH {TIMELINE} SELECT log_id, root_event, primary_event, primary_exception, array_to_string(primary_startup, '|') AS primary_startup, exceptions, high FROM timeline",
    "w10_distinct_findings": f"WITH {LOG}, {FINDINGS} SELECT log_id, line_no, error_type, symbol, api_hint, severity FROM found",
    "w11_history": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts DESC, event_id DESC) = 1) QUALIFY place <= 10",
    "w12_first_rule": f"WITH {ISSUES} SELECT log_id, line_no, token, severity, category, class_name, resource FROM issues",
    "j9_patched_lines": f"WITH {ISSUES}, s AS (SELECT DISTINCT 'assets/res/' || event_type || '.png' AS path, event_type || '.png' AS name FROM events) SELECT path, count(*) AS lines, count(DISTINCT log_id) AS logs FROM issues JOIN s ON contains(lower(line), lower(name)) GROUP BY path",
    "j10_startup_overlap": f"WITH {SCORED_EVENTS} SELECT log_id, event, array_to_string(startup_overlap, '|') AS startup_overlap, score FROM scored WHERE len(startup_overlap) > 0",
    "a14_log_frequencies": f"WITH {ISSUES} SELECT kind, name, count(*) AS n FROM (SELECT 'token' AS kind, token AS name FROM issues UNION ALL SELECT 'class_name', class_name FROM issues UNION ALL SELECT 'resource', resource FROM issues) WHERE name <> '' GROUP BY kind, name",
    "a15_log_status": f"WITH {ISSUES} SELECT log_id, count_if(severity = 'HIGH') AS high, count_if(severity = 'MEDIUM') AS medium, CASE WHEN count_if(severity = 'HIGH') > 0 THEN 'FAIL' ELSE 'WARNING' END AS status FROM issues GROUP BY log_id",
    "x16_correlation": f"WITH {LOG}{REPORTS}, {CORRELATED} SELECT log_id, findings, {_J('frames', 'matched_apis', 'matched_startup', 'failing_path')}, probable_cause FROM pathed",
    "x17_diagnosis": f"WITH {TIMELINE}, {CORRELATED} {_X17}",
    "a16_diagnosis_summary": f"WITH {TIMELINE}, {CORRELATED}, d AS ({_X17}) SELECT probable_cause, primary_exception, count(*) AS logs, sum(exceptions)::BIGINT AS exceptions FROM d GROUP BY ALL",
    "o6_matched_apis": f"WITH {LOG}{REPORTS}, {CORRELATED} SELECT log_id, array_to_string(matched_apis, '|') AS matched_apis FROM pathed",
}
