"""Queries over lines of documents: sources, language scores, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import constants as K
from .functions import text as T
from .functions.language import classify, shape, threshold
from .operators import byte_runs, strings as S
from .sources import tables as src
from .sources import text_resources as res

LINES = r"lines AS (SELECT doc_id, source, unnest(range(len(p)))::INT AS idx, unnest(p) AS value, 'resource-text' AS kind FROM (SELECT doc_id, source, string_split_regex(text, '\r\n|\r|\n') AS p FROM documents))"
KEYED = LINES + ", strings AS (SELECT *, concat_ws('␟', doc_id::VARCHAR, source, kind, idx::VARCHAR, value) AS key FROM lines)"
TRANSLATED = KEYED + ", translations AS (SELECT key, CASE (doc_id + idx) % 4 WHEN 0 THEN 'vi: ' || value WHEN 1 THEN value ELSE '  ' END AS translation FROM strings WHERE (doc_id + idx) % 4 < 3)"
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _rx(c: str, name: str) -> str:
    return f"regexp_matches({c}, '{K.SHAPES[name]}')"


def _n(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


PREPARED = (
    LINES
    + rf""", prep AS (SELECT *, lower(s) AS low, lower(source) AS path, length(s) AS n, trim(lower(s), ' .,!?:;…-''"') AS label,
    regexp_extract_all(s, '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:''[\p{{L}}\p{{Nl}}\p{{No}}]+)?') AS words,
    {_n("s", r"\p{L}")} AS letters, {_n("s", r"\p{Nd}")} AS digits, {_n("s", WS)} AS spaces, {_n("s", r"[^\p{L}\p{N} ]")} AS punct, {_n("s", K.CJK)} AS cjk
    FROM (SELECT *, regexp_replace(regexp_replace(value, '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS s FROM lines))"""
)
_LOWER, _UPPER = r"(s = low AND regexp_matches(s, '\p{Ll}'))", r"(s = upper(s) AND regexp_matches(s, '\p{Lu}'))"
_TITLE = r"regexp_matches(s, '^(?:[^\p{L}]*\p{Lu}\p{Ll}*)+[^\p{L}]*$')"
_UI, _LABEL_UI = f"low IN {_in(K.UI_WORDS)}", f"label IN {_in(K.UI_WORDS)}"
_DISPLAY = rf"(regexp_matches(s, '^\p{{L}}+$') AND ({_UPPER} OR {_TITLE}))"
# the rules that can fire on text resources
_SQL_RULES = [
    ("contains(value, chr(0))", "-35"), (_rx("s", "url"), "-80"), (_rx("s", "email"), "-70"), (_rx("s", "descriptor"), "-100"),
    (f"({_rx('s', 'uuid')} OR {_rx('s', 'hex')})", "-80"), (_rx("s", "markup"), "-70"), (_rx("s", "mime"), "-65"), (_rx("s", "package"), "-70"),
    (_rx("s", "path"), "-65"), (_rx("s", "path_fragment"), "-85"), (_rx("s", "metadata_key"), "-90"), (f"{_rx('s', 'file_name')} AND NOT contains(s, ' ')", "-55"),
    (_rx("s", "printf"), "-60"), (f"{_rx('s', 'constant')} AND NOT {_UI}", "-55"), (f"{_rx('s', 'snake_case')} AND NOT {_UI}", "-50"),
    (f"{_rx('s', 'camel_case')} AND n >= 6 AND NOT {_UI}", "-42"), (_any("low", K.PLATFORM_REFERENCES), "-90"),
    ("cjk >= 2", "34"), ("cjk >= 2 AND cjk / greatest(1, n) >= 0.45", "12"), ("cjk >= 2 AND n BETWEEN 2 AND 12", "8"),
    (_LABEL_UI, "90"), (f"NOT {_LABEL_UI} AND {_rx('s', 'numeric_label')}", "60"),
    (f"NOT {_LABEL_UI} AND NOT {_rx('s', 'numeric_label')} AND label IN {_in(K.TECHNICAL_WORDS)} AND len(words) = 1", "-48"),
    (_any("path", K.PATH_HINTS), "22"), (_any("path", K.CODE_PATHS), "-12"), ("len(words) >= 2", "24"), ("len(words) >= 4", "12"),
    ("TRUE", f"least(24, 6 * len(list_filter(words, lambda w: lower(w) IN {_in(K.HINT_WORDS)})))"), ("spaces > 0", "8"), ("regexp_matches(s, '[.!?…]$')", "9"),
    (f"len(words) = 1 AND n BETWEEN 2 AND 20 AND words[1] = s AND ({_LOWER} OR {_UPPER} OR {_TITLE})", "14"),
    (f"n BETWEEN 1 AND 4 AND {_LABEL_UI}", "20"), (f"n BETWEEN 1 AND 4 AND NOT {_LABEL_UI} AND {_DISPLAY}", "6"), (f"n BETWEEN 1 AND 4 AND NOT {_LABEL_UI} AND NOT {_DISPLAY}", "-12"),
    ("letters / greatest(1, n) >= 0.65", "10"), ("letters / greatest(1, n) < 0.30", "-28"), ("digits / greatest(1, n) > 0.45", "-25"), ("punct / greatest(1, n) > 0.30 AND spaces = 0", "-22"),
    ("n BETWEEN 12 AND 800 AND spaces = 0 AND len(words) <= 1 AND list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: -(len(list_filter(string_split(s, ''), lambda d: d = c)) / n) * log2(len(list_filter(string_split(s, ''), lambda d: d = c)) / n))) >= 4.0", "-22"),
]
SCORED = PREPARED + ", scored AS (SELECT *, CASE WHEN n = 0 OR n > 800 THEN -100 WHEN letters = 0 THEN -100 WHEN " + _rx("s", "extension") + " THEN -100 ELSE " + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in _SQL_RULES) + " END::INT AS score FROM prep)"
CANDIDATES = SCORED + f""", grouped AS (SELECT source, count(*) AS n, count_if(score >= 40) AS strong, count_if(score BETWEEN 20 AND 39) AS medium, avg(score) AS mean,
    count_if(trim(lower(value), ' .,!?:;…-''"') IN {_in(K.UI_WORDS)}) AS ui, count_if(len(regexp_extract_all(value, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+(?:''[\\p{{L}}\\p{{Nl}}\\p{{No}}]+)?')) >= 2) AS multi FROM scored GROUP BY source),
    candidates AS (SELECT source, n, strong, medium, ui, multi, greatest(0, least(100, least(35, 5 * strong) + least(15, 2 * medium) + least(30, 6 * ui)
    + CASE WHEN {_any("lower(source)", K.PATH_HINTS)} THEN 22 ELSE 0 END + CASE WHEN multi / n >= 0.30 THEN 12 ELSE 0 END + CASE WHEN mean >= 35 THEN 15 WHEN mean >= 22 THEN 8 ELSE 0 END
    + CASE WHEN n >= 5 THEN 5 ELSE 0 END + CASE WHEN n >= 20 AND strong / n >= 0.30 THEN 5 ELSE 0 END))::INT AS candidate_score FROM grouped)"""


def rank_sources(spark, sf_dir):
    """Sources by language quality: lines, scores, first accepted of equal values, candidate score, rank."""
    kept = S.accepted(src.lines(spark, sf_dir, deal=True), ["source"], ["doc_id", "idx"])
    return S.ranked_candidates(kept, ["source"]).select("source", "n", "strong", "medium", "candidate_score")


def s2_manifest_entries(spark, sf_dir):
    """Manifests told by lines: a key for each of four places, values continued on a second line."""
    row = F.concat(F.lit("MIDlet-"), (F.col("idx") % 4).cast("string"), F.when(F.col("idx") % 2 == 0, " : ").otherwise(":"), F.substring("value", 1, 20), F.lit("\r\n "), F.substr("value", F.lit(21)))
    rows = src.lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", row.alias("row")))).alias("rows"))
    return res.manifest_entries(rows.select("doc_id", F.array_join(F.col("rows.row"), "\r\n").alias("text")))


def s3_text_strings(spark, sf_dir):
    return res.text_strings(src.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "idx", "value")


def s4_key_value_strings(spark, sf_dir):
    return res.key_value_strings(src.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "idx", "value")


def e1_ascii_runs(spark, sf_dir):
    docs = src.read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return byte_runs.ascii_runs(docs, "content", 4)


def e2_utf8_runs(spark, sf_dir):
    docs = src.read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return byte_runs.utf8_runs(docs, "content")


def e3_utf16_runs(spark, sf_dir):
    """Runs in texts that are written in either byte order by their number."""
    docs = src.read(spark, sf_dir, "documents").select("doc_id", "text")
    little, big = docs.where("doc_id % 2 = 0").select("doc_id", F.encode("text", "UTF-16LE").alias("content")), docs.where("doc_id % 2 = 1").select("doc_id", F.encode("text", "UTF-16BE").alias("content"))
    return byte_runs.utf16_runs(little, "content").unionByName(byte_runs.utf16_runs(big, "content", big_endian=True))


def e6_quality_score(spark, sf_dir):
    return src.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(T.quality_score("text") + 1e-9, 6).alias("quality"))


def e7_mojibake_repair(spark, sf_dir):
    words = src.read(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\r]+")).alias("word")).distinct().where(F.col("word").rlike(r"^[\x{0}-\x{ff}]+$"))
    damaged = F.decode(F.encode("word", "utf-8"), "ISO-8859-1")
    return words.select("word", T.repair_mojibake(damaged).alias("repaired"))


def e8_script_count(spark, sf_dir):
    return src.read(spark, sf_dir, "documents").select("doc_id", T.script_count("text").cast("long").alias("cjk"), T.count_of(F.col("text"), r"\p{L}").cast("long").alias("letters"))


def e9_mixed_islands(spark, sf_dir):
    docs = src.read(spark, sf_dir, "documents").withColumn("data", F.concat(F.unhex(F.lit("05ff")), F.encode("text", "utf-8"), F.unhex(F.lit("c300"))))
    return docs.select("doc_id", F.sha2(T.mixed_islands(F.col("data")), 256).alias("text_sha256"), T.structural_bytes(F.col("data")).alias("structural"))


def e10_structural_bytes(spark, sf_dir):
    docs = src.read(spark, sf_dir, "documents").withColumn("data", F.concat(F.encode("text", "utf-8"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("01"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("ff"))).otherwise(F.unhex(F.lit("0a")))))
    return docs.select("doc_id", T.structural_bytes(F.col("data")).alias("structural"))


def e17_human_lines(spark, sf_dir):
    return src.lines(spark, sf_dir).where(S.looks_human(F.col("value"))).select("doc_id", "idx")


def p1_language_score(spark, sf_dir):
    return classify(src.lines(spark, sf_dir)).select("doc_id", "idx", "score")


def p2_threshold(spark, sf_dir):
    scored = classify(src.lines(spark, sf_dir))
    return scored.groupBy("source").agg(F.count_if(F.col("score") >= threshold(F.col("kind"))).alias("accepted"), F.min("score").alias("least"), F.max("score").alias("most"))


def p3_entropy(spark, sf_dir):
    return src.lines(spark, sf_dir).select("doc_id", "idx", F.round(T.entropy("value"), 6).alias("bits"))


def p4_word_tokens(spark, sf_dir):
    words = T.word_tokens("value")
    return src.lines(spark, sf_dir).select("doc_id", "idx", F.size(words).cast("long").alias("n_words"), F.array_join(words, " ").alias("words"))


_SHAPES = ("url", "email", "descriptor", "uuid", "hex", "markup", "mime", "package", "path", "path_fragment", "metadata_key", "file_name", "extension", "printf", "constant", "snake_case", "camel_case", "command_script")


def p5_technical_shapes(spark, sf_dir):
    urls = src.read(spark, sf_dir, "pages").select("page_id", "url", T.base_name("url").alias("name"))
    return urls.select("page_id", *[shape(F.col("url"), s).alias(f"url_{s}") for s in _SHAPES], *[shape(F.col("name"), s).alias(f"name_{s}") for s in _SHAPES])


def p6_word_lists(spark, sf_dir):
    words = src.lines(spark, sf_dir).select("doc_id", F.explode(T.word_tokens(F.lower("value"))).alias("word"))
    lists = {"ui": K.UI_WORDS, "hint": K.HINT_WORDS, "technical": K.TECHNICAL_WORDS, "script": K.SCRIPT_WORDS}
    return words.groupBy("doc_id").agg(*[F.count_if(F.col("word").isin(*v)).alias(k) for k, v in lists.items()])


def _rows(spark, sf_dir):
    strings = src.strings(spark, sf_dir)
    joined = strings.join(src.translations(strings), "key", "left")
    return joined.withColumn("status", S.row_status(F.col("value"), F.col("translation")))


def p7_row_status(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", "idx", "status")


def p8_search(spark, sf_dir):
    return S.search(_rows(spark, sf_dir), "The", status="translated").select("doc_id", "idx", "status")


def p9_exportable(spark, sf_dir):
    kinds = F.array(F.lit("class-string:x"), F.lit("resource-text"), F.lit("binary:u8:safe"), F.lit("binary:u8"), F.lit("deep-text"))
    rows = src.lines(spark, sf_dir).withColumn("kind", F.get(kinds, (F.col("idx") % 5).cast("int")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(S.exportable(F.col("kind"))).alias("exportable"))


def p10_metrics(spark, sf_dir):
    return src.lines(spark, sf_dir).select("doc_id", "idx", F.char_length("value").cast("long").alias("chars"), F.octet_length("value").cast("long").alias("bytes"))


def p11_encodable(spark, sf_dir):
    return src.read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"^[\x00-\x7f]*$").alias("ascii"), F.col("text").rlike(r"^[\x{0}-\x{ff}]*$").alias("latin1"))


def f1_placeholders(spark, sf_dir):
    return src.read(spark, sf_dir, "pages").select("page_id", F.array_join(T.placeholders("html"), "|").alias("placeholders"))


def f2_placeholders_preserved(spark, sf_dir):
    pages = src.read(spark, sf_dir, "pages").withColumn("other", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x "), F.col("html"))).otherwise(F.concat(F.col("html"), F.lit("<i>"))))
    return pages.select("page_id", T.placeholders_preserved("html", "other").alias("preserved"))


def f3_sha256(spark, sf_dir):
    return src.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def f4_normal_forms(spark, sf_dir):
    return src.lines(spark, sf_dir).select("doc_id", "idx", T.normal_space("value").alias("normal"), T.label_form("value").alias("label"))


def f5_paths(spark, sf_dir):
    return src.read(spark, sf_dir, "pages").select("page_id", T.extension("url").alias("extension"), T.base_name("url").alias("base_name"), T.class_name("url").alias("class_name"))


def f6_endpoints(spark, sf_dir):
    return src.read(spark, sf_dir, "pages").select("page_id", F.array_join(T.endpoints("html", "https"), "|").alias("endpoints"))


def f13_safe_name(spark, sf_dir):
    return src.lines(spark, sf_dir).select("doc_id", "idx", T.safe_name("value").alias("name"))


def w1_first_accepted(spark, sf_dir):
    return S.accepted(src.lines(spark, sf_dir, deal=True), ["source"], ["doc_id", "idx"]).select("source", "doc_id", "idx", "score")


def w2_first_of_key(spark, sf_dir):
    return S.first_of_key(src.lines(spark, sf_dir), ["source", "value"], ["doc_id", "idx"]).select("source", "doc_id", "idx")


def w3_export_ids(spark, sf_dir):
    return S.export_ids(src.lines(spark, sf_dir), "source", ["doc_id", "idx"]).select("source", "doc_id", "idx", "id")


def a1_candidate_scores(spark, sf_dir):
    return S.candidate_scores(src.lines(spark, sf_dir), ["source"]).select("source", "n", "strong", "medium", "ui", "multi", "candidate_score")


def a3_filter_counts(spark, sf_dir):
    return S.filter_counts(src.lines(spark, sf_dir), "source")


def a4_progress(spark, sf_dir):
    return S.progress(_rows(spark, sf_dir))


def t1_ranked_candidates(spark, sf_dir):
    return S.ranked_candidates(src.lines(spark, sf_dir), ["source"]).select("source", "n", "candidate_score")


def t2_top_candidates(spark, sf_dir):
    return S.ranked_candidates(src.lines(spark, sf_dir), ["source"]).select("source", "n", "candidate_score").limit(20)


def t3_shown_rows(spark, sf_dir):
    return S.shown_rows(src.lines(spark, sf_dir).select("doc_id", "idx"), ["doc_id", "idx"])


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.isidentifier() and not f.__name__.startswith("_")}

_STRIP = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
_RES = LINES + f", res AS (SELECT doc_id, idx, line FROM (SELECT doc_id, idx, {_STRIP('value')} AS line FROM lines) WHERE line <> '' AND NOT regexp_matches(line, '^(?:#|;|//)'))"
_PH = lambda c: "list_sort(list_concat(" + ", ".join(f"regexp_extract_all({c}, '{p}')" for p in K.PLACEHOLDERS) + "))"
_ROWS = TRANSLATED + ", rows AS (SELECT s.*, t.translation, CASE WHEN trim(coalesce(t.translation, '')) = '' THEN 'untranslated' WHEN trim(t.translation) = s.value THEN 'needs review' ELSE 'translated' END AS status FROM strings s LEFT JOIN translations t USING (key))"
_QUALITY = lambda c: rf"(({_n(c, r'[^\p{C}\p{Zl}\p{Zp}\p{Zs}]|[ \t\r\n]')} * 1.2 + {_n(c, r'\p{L}')} * 0.6 + {_n(c, K.CJK)} * 0.9 - {_n(c, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')} * 1.7 - {_n(c, r'\x{fffd}')} * 3.0 - {_n(c, K.MOJIBAKE)} * 0.9 - {_n(c, '\\x00')} * 1.2) / length({c}))"
_DAMAGED = "word"
for _c in [0xC3, 0xC2, *(c for c in range(0xA0, 0x100) if c not in (0xC2, 0xC3))]:  # the lead bytes' own characters first
    _DAMAGED = f"replace({_DAMAGED}, chr({_c}), chr({chr(_c).encode()[0]}) || chr({chr(_c).encode()[1]}))"

ORACLE_SQL = {
    "rank_sources": SCORED + ", first AS (SELECT * FROM scored WHERE score >= 14 AND s <> '' QUALIFY row_number() OVER (PARTITION BY source, s ORDER BY doc_id, idx) = 1)" + CANDIDATES.removeprefix(SCORED).replace("FROM scored", "FROM first") + " SELECT source, n, strong, medium, candidate_score FROM candidates",
    "s2_manifest_entries": f"WITH {LINES} SELECT doc_id, 'midlet-' || (idx % 4) AS key, arg_max({_STRIP('value')}, idx) AS value FROM lines GROUP BY doc_id, idx % 4",
    "s3_text_strings": f"WITH {_RES} SELECT * FROM (SELECT doc_id, idx, CASE WHEN contains(line, '=') THEN {_STRIP("substr(line, strpos(line, '=') + 1)")} ELSE line END AS value FROM res) WHERE value <> ''",
    "s4_key_value_strings": f"WITH {_RES} SELECT doc_id, idx, CASE WHEN contains(line, '=') THEN coalesce(nullif({_STRIP("substr(line, strpos(line, '=') + 1)")}, ''), line) WHEN contains(line, ':') AND strpos(line, ':') - 1 < 40 THEN coalesce(nullif({_STRIP("substr(line, strpos(line, ':') + 1)")}, ''), line) ELSE line END AS value FROM res",
    "e3_utf16_runs": r"SELECT doc_id, unnest(regexp_extract_all(text, '[\x20-\x7e\t\p{L}]{2,}')) AS value FROM documents",
    "e6_quality_score": f"SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN round({_QUALITY('text')} + 1e-9, 6) ELSE -10.0 END AS quality FROM conversations",
    "e7_mojibake_repair": f"SELECT word, CASE WHEN regexp_matches(damaged, '{K.MOJIBAKE}') AND {_QUALITY('word')} > {_QUALITY('damaged')} + 0.08 THEN word ELSE damaged END AS repaired FROM (SELECT word, {_DAMAGED} AS damaged FROM (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS word FROM documents) WHERE regexp_full_match(word, '[\\x{{0}}-\\x{{ff}}]+')))",
    "e8_script_count": rf"SELECT doc_id, {_n('text', K.CJK)} AS cjk, {_n('text', r'\p{L}')} AS letters FROM documents",
    "e9_mixed_islands": "SELECT doc_id, sha256(chr(5) || chr(255) || text || chr(195) || chr(0)) AS text_sha256, TRUE AS structural FROM documents",
    "e10_structural_bytes": r"SELECT doc_id, doc_id % 3 <> 2 OR regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') AS structural FROM documents",
    "e17_human_lines": rf"WITH {LINES}, h AS (SELECT doc_id, idx, trim(value) AS s FROM lines) SELECT doc_id, idx FROM h WHERE length(s) BETWEEN 2 AND 800 AND regexp_matches(s, '\p{{L}}') AND NOT (length(s) > 12 AND regexp_matches(s, '^[A-Za-z0-9_/$.;<>\[\]():+-]+$') AND (contains(s, '/') OR contains(s, ';') OR {_n('s', '[.]')} >= 2)) AND {_n('s', r'[^\p{C}\p{Zl}\p{Zp}\p{Zs}]|[ \t\r\n]')} / length(s) * 0.55 + {_n('s', r'\p{L}')} / length(s) * 0.55 - {_n('s', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')} * 0.2 >= 0.55",
    "p1_language_score": f"WITH {SCORED} SELECT doc_id, idx, score FROM scored",
    "p2_threshold": f"WITH {SCORED} SELECT source, count_if(score >= 14) AS accepted, min(score) AS least, max(score) AS most FROM scored GROUP BY source",
    "p3_entropy": f"WITH {LINES}, c AS (SELECT doc_id, idx, value AS s FROM lines), k AS (SELECT doc_id, idx, s, unnest(CASE WHEN s = '' THEN ['x'] ELSE list_distinct(string_split(s, '')) END) AS ch FROM c) SELECT doc_id, idx, round(coalesce(sum(CASE WHEN s = '' THEN 0.0 ELSE -((length(s) - length(replace(s, ch, ''))) / length(s)) * log2((length(s) - length(replace(s, ch, ''))) / length(s)) END), 0), 6) AS bits FROM k GROUP BY doc_id, idx",
    "p4_word_tokens": rf"WITH {LINES} SELECT doc_id, idx, len(w) AS n_words, array_to_string(w, ' ') AS words FROM (SELECT doc_id, idx, regexp_extract_all(value, '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:''[\p{{L}}\p{{Nl}}\p{{No}}]+)?') AS w FROM lines)",
    "p5_technical_shapes": "SELECT page_id, " + ", ".join([f"{_rx('url', s)} AS url_{s}" for s in _SHAPES] + [f"{_rx('name', s)} AS name_{s}" for s in _SHAPES]) + r" FROM (SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS name FROM pages)",
    "p6_word_lists": rf"WITH {LINES}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(value), '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:''[\p{{L}}\p{{Nl}}\p{{No}}]+)?')) AS word FROM lines) SELECT doc_id, " + ", ".join(f"count_if(word IN {_in(v)}) AS {k}" for k, v in (("ui", K.UI_WORDS), ("hint", K.HINT_WORDS), ("technical", K.TECHNICAL_WORDS), ("script", K.SCRIPT_WORDS))) + " FROM w GROUP BY doc_id",
    "p7_row_status": f"WITH {_ROWS} SELECT doc_id, idx, status FROM rows",
    "p8_search": f"WITH {_ROWS} SELECT doc_id, idx, status FROM rows WHERE status = 'translated' AND (contains(lower(value), 'the') OR contains(lower(coalesce(translation, '')), 'the') OR contains(lower(source), 'the'))",
    "p9_exportable": f"WITH {LINES}, k AS (SELECT (['class-string:x', 'resource-text', 'binary:u8:safe', 'binary:u8', 'deep-text'])[(idx % 5 + 1)::INT] AS kind FROM lines) SELECT kind, count(*) AS n, count_if(kind LIKE 'class-string%' OR kind = 'resource-text' OR kind LIKE 'binary:%:safe') AS exportable FROM k GROUP BY kind",
    "p10_metrics": f"WITH {LINES} SELECT doc_id, idx, length(value) AS chars, strlen(value) AS bytes FROM lines",
    "p11_encodable": r"SELECT doc_id, regexp_full_match(text, '[\x00-\x7f]*') AS ascii, regexp_full_match(text, '[\x{0}-\x{ff}]*') AS latin1 FROM documents",
    "f1_placeholders": f"SELECT page_id, array_to_string({_PH('html')}, '|') AS placeholders FROM pages",
    "f2_placeholders_preserved": f"SELECT page_id, {_PH('html')} = {_PH('other')} AS preserved FROM (SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN 'x ' || html ELSE html || '<i>' END AS other FROM pages)",
    "f3_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "f4_normal_forms": f"WITH {LINES} SELECT doc_id, idx, regexp_replace(regexp_replace(value, '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS normal, trim(lower(value), ' .,!?:;…-''\"') AS label FROM lines",
    "f5_paths": r"SELECT page_id, lower(regexp_extract(url, '\.([^./\\]*)$', 1)) AS extension, regexp_extract(url, '([^/\\]*)$', 1) AS base_name, replace(regexp_replace(regexp_replace(replace(url, '\', '/'), '^/+', ''), '(?i)\.class$', ''), '/', '.') AS class_name FROM pages",
    "f13_safe_name": rf"WITH {LINES} SELECT doc_id, idx, coalesce(nullif(trim(regexp_replace(value, '[^\p{{L}}\p{{N}}\-_.]', '_', 'g'), '._'), ''), 'unnamed') AS name FROM lines",
    "w1_first_accepted": f"WITH {SCORED} SELECT source, doc_id, idx, score FROM scored WHERE score >= 14 AND s <> '' QUALIFY row_number() OVER (PARTITION BY source, s ORDER BY doc_id, idx) = 1",
    "w2_first_of_key": f"WITH {LINES} SELECT source, doc_id, idx FROM lines QUALIFY row_number() OVER (PARTITION BY source, value ORDER BY doc_id, idx) = 1",
    "w3_export_ids": f"WITH {LINES} SELECT source, doc_id, idx, printf('T%05d', row_number() OVER (PARTITION BY source ORDER BY doc_id, idx)) AS id FROM lines",
    "a1_candidate_scores": f"WITH {CANDIDATES} SELECT source, n, strong, medium, ui, multi, candidate_score FROM candidates",
    "a3_filter_counts": f"WITH {SCORED} SELECT source, count_if(score >= 14) AS accepted, count_if(score < 14) AS rejected FROM scored GROUP BY source",
    "a4_progress": f"WITH {_ROWS} SELECT source, doc_id, count(*) AS total, count_if(status <> 'untranslated') AS translated, count_if(status = 'untranslated') AS untranslated, round(count_if(status <> 'untranslated') / count(*), 6) AS ratio, round_even(count_if(status <> 'untranslated') / count(*) * 100, 0)::INT AS percent FROM rows GROUP BY ROLLUP (source, doc_id)",
    "t1_ranked_candidates": f"WITH {CANDIDATES} SELECT source, n, candidate_score FROM candidates",
    "t2_top_candidates": f"WITH {CANDIDATES} SELECT source, n, candidate_score FROM candidates ORDER BY candidate_score DESC, n DESC, source LIMIT 20",
    "t3_shown_rows": f"WITH {LINES} SELECT doc_id, idx, (SELECT count(*) FROM lines) AS total FROM lines ORDER BY doc_id, idx LIMIT 3000",
}
ORACLE_SQL |= {
    # the bytes of UTF-8 beyond ASCII are in no run, so runs of the text are runs of its bytes; places are sums of bytes
    "e1_ascii_runs": r"WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7e]{4,}') AS r, string_split_regex(text, '[\x20-\x7e]{4,}') AS g FROM documents), u AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS value, unnest(g[1:len(r)]) AS gap FROM p) SELECT doc_id, (sum(strlen(gap) + strlen(value)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(value))::BIGINT AS start, value FROM u",
    "e2_utf8_runs": r"SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x1f\x7f]{2,}')) AS value FROM documents) WHERE regexp_matches(value, '[^\x00-\x7f]')",
    "f6_endpoints": r"WITH h AS (SELECT page_id, html, unnest(range(1, length(html) + 1)) AS i FROM pages WHERE contains(lower(html), 'https://')), e AS (SELECT page_id, list_sort(list(DISTINCT regexp_extract(substr(html, i, 160), '^[\x20-\x7e]+'))) AS l FROM h WHERE substr(html, i, 1) IN ('h', 'H') AND lower(substr(html, i, 8)) = 'https://' GROUP BY page_id) SELECT page_id, coalesce(array_to_string(l, '|'), '') AS endpoints FROM pages LEFT JOIN e USING (page_id)",
}
ORACLE_SQL["rank_sources"] = "WITH " + ORACLE_SQL["rank_sources"]
