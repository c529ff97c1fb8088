"""Compatibility of archives: APIs they use, flows they hint at, startup assessment, reports and their comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.codecs import encodable
from ..functions.text import SPACE, any_in, base_name, extension


def _strings() -> Column:
    return F.array().cast("array<string>")


def api_dimension(spark: SparkSession) -> DataFrame:
    """(profile, api, support, cost): a fixed small table."""
    rows = [(p, a, s, K.API_COST[a]) for p, kinds in K.PROFILES.items() for s, apis in kinds.items() for a in apis]
    return spark.createDataFrame(rows, "profile string, api string, support string, cost int")


def detected_apis(entries: DataFrame, content: str = "content") -> DataFrame:
    """(archive_id, source, api): an entry uses an API if its content holds one of the signatures, in any case.

    The signatures are a fixed list in the expression, so entries are read once and no join is needed.
    """
    low = F.lower(content)
    found = [F.when(any_in(low, tuple(s.lower() for s in signs)), F.lit(api)) for api, signs in K.API_SIGNATURES.items()]
    return entries.select("archive_id", "source", F.explode(F.array_compact(F.array(*found))).alias("api"))


def api_sources(apis: DataFrame) -> DataFrame:
    got = apis.groupBy("archive_id", "api").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return got.withColumn("first_three", F.slice("sources", 1, 3))


def profile_support(apis: DataFrame) -> DataFrame:
    """(archive_id, profile, native, conditional, unsupported, score, risk) for every profile at once."""
    dims = F.broadcast(api_dimension(apis.sparkSession))  # a few dozen fixed rows
    rows = apis.select("archive_id", "api").distinct().join(dims, "api")
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("support") == s, F.col("api")))).alias(s)
    got = rows.groupBy("archive_id", "profile").agg(of("native"), of("conditional"), of("unsupported"))
    score = F.greatest(F.lit(0), 100 - 10 * F.size("conditional") - 25 * F.size("unsupported"))
    return got.withColumn("score", score).withColumn("risk", F.when(F.size("unsupported") > 0, "high").when(F.size("conditional") > 0, "medium").otherwise("low"))


def runtime_reports(archives: DataFrame, apis: DataFrame, profile: str = "freej2me_rg35xx") -> DataFrame:
    """Score and risk of every archive: own costs and the target's, the worse of the two."""
    used = apis.select("archive_id", "api").distinct()
    costs = reduce(lambda a, kv: F.when(F.col("api") == kv[0], kv[1]).otherwise(a), K.API_COST.items(), F.lit(0))
    own = used.groupBy("archive_id").agg(F.array_sort(F.collect_set("api")).alias("detected_apis"), F.sum(costs).alias("cost"))
    target = profile_support(apis).where(F.col("profile") == profile).select("archive_id", "conditional", "unsupported", F.col("score").alias("target_score"))
    rows = archives.select("archive_id").distinct().join(own, "archive_id", "left").join(target, "archive_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, _strings()) for c in ("detected_apis", "conditional", "unsupported")})
    heavy = F.arrays_overlap("detected_apis", F.array(*[F.lit(a) for a in ("wma_sms", "nokia", "samsung", "siemens", "sonyericsson", "motorola")]))
    light = F.arrays_overlap("detected_apis", F.array(*[F.lit(a) for a in ("m3g", "bluetooth", "file_connection")]))
    rank = F.greatest(F.when(heavy, 2).when(light, 1).otherwise(0), F.when(F.size("unsupported") > 0, 2).when(F.size("conditional") > 0, 1).otherwise(0))
    score = F.least(F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0))), F.coalesce("target_score", F.lit(100)))
    return rows.select("archive_id", "detected_apis", "conditional", "unsupported", score.cast("int").alias("compatibility_score"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), rank + 1).alias("runtime_risk"))


def flow_terms(entries: DataFrame, content: str = "content") -> DataFrame:
    """(archive_id, source, is_class, terms, wma): entries whose name or content hints at activation or payment."""
    name, low = F.lower("source"), F.lower(content)
    is_class = name.endswith(".class")
    readable = is_class | extension("source").isin("txt", "properties", "xml", "ini", "cfg", "json", "csv", "lang", "lng", "dat", "bin", "res")
    hits = lambda c, words: F.array_compact(F.array(*[F.when(c.contains(w), F.lit(w)) for w in words]))
    inside = F.when(readable, F.concat(hits(low, K.FLOW_TERMS), hits(F.col(content), K.FLOW_CJK))).otherwise(_strings())
    wma = readable & (low.contains("javax/wireless/messaging/") | low.contains("messageconnection") | low.contains("sms://"))
    rows = entries.select("archive_id", "source", is_class.alias("is_class"), F.array_sort(F.array_distinct(F.concat(hits(name, K.FLOW_NAMES), inside))).alias("terms"), wma.alias("wma"))
    return rows.where(F.size("terms") > 0)


def activation_reports(archives: DataFrame, flows: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Score 0..100 and risk of activation and payment flows; reach(archive_id, activation_reachable, payment_reachable)."""
    terms = F.array_distinct(F.flatten(F.collect_list("terms")))
    got = flows.groupBy("archive_id").agg(F.count_if("is_class").alias("classes"), F.count_if(~F.col("is_class")).alias("resources"), F.bool_or("wma").alias("wma_linked"), terms.alias("terms"))
    rows = archives.select("archive_id").distinct().join(got, "archive_id", "left")
    if reach is not None:
        rows = rows.join(reach, "archive_id", "left")
    else:
        rows = rows.withColumns({"activation_reachable": F.lit(False), "payment_reachable": F.lit(False)})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("classes", "resources")} | {c: F.coalesce(c, F.lit(False)) for c in ("wma_linked", "activation_reachable", "payment_reachable")})
    has = lambda words: F.coalesce(F.arrays_overlap("terms", F.array(*[F.lit(w) for w in words])), F.lit(False))
    rows = rows.withColumn("gate", has(K.ACTIVATION_TERMS) & ((F.col("classes") > 0) | F.col("wma_linked"))).withColumn("payment", has(K.PAYMENT_TERMS) & ((F.col("classes") > 0) | F.col("wma_linked")))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(F.col("classes") > 0, F.least(F.lit(45), 12 + 8 * F.col("classes"))) + F.least(F.lit(20), 5 * F.col("resources")) + points(F.col("wma_linked"), 30)
    score = score + points(F.col("gate"), 15) + points(F.col("payment"), 15) + points(F.col("activation_reachable"), 20) + points(F.col("payment_reachable"), 10)
    rows = rows.withColumn("flow_score", F.least(F.lit(100), score).cast("int"))
    return rows.withColumn("flow_risk", F.when(F.col("flow_score") >= 60, "high").when(F.col("flow_score") >= 30, "medium").otherwise("low")).drop("terms")


def startup_assessment(reports: DataFrame) -> DataFrame:
    """Adds startup_classification, startup_severity and startup_reasons to runtime and activation columns side by side."""
    uses_wma = F.array_contains("detected_apis", "wma_sms")
    unsupported, conditional = F.size("unsupported") > 0, F.size("conditional") > 0
    reachable = F.col("activation_reachable") | F.col("payment_reachable")
    kind = (
        F.when(reachable & (F.col("wma_linked") | uses_wma | unsupported), "likely_startup_blocker")
        .when(F.col("flow_risk").isin("medium", "high") | F.col("gate") | F.col("payment"), "optional_feature_risk")
        .when(unsupported | uses_wma, "runtime_only_incompatibility")
        .when(conditional, "needs_runtime_test")
        .otherwise("compatible_or_unknown")
    )
    said = F.array_compact(
        F.array(
            F.when(unsupported, F.concat(F.lit("unsupported: "), F.array_join(F.array_sort("unsupported"), ", "))),
            F.when(conditional, F.concat(F.lit("to be tested: "), F.array_join(F.array_sort("conditional"), ", "))),
            F.when(uses_wma, F.lit("legacy messaging")),
            F.when(F.col("gate"), F.lit("activation gate")),
            F.when(F.col("payment"), F.lit("payment flow")),
            F.when(F.col("wma_linked"), F.lit("flow linked to messaging")),
            F.when(reachable, F.lit("reachable from entry")),
        )
    )
    severity = F.when(kind == "likely_startup_blocker", "high").when((kind == "runtime_only_incompatibility") & unsupported, "high").when(kind == "compatible_or_unknown", "low").otherwise("medium")
    return reports.withColumns({"startup_classification": kind, "startup_severity": severity, "startup_reasons": said})


def recommended_actions(reports: DataFrame) -> DataFrame:
    """Adds actions (priority, category, detail; best first) and next_action, from startup_path, unsupported, conditional and suspicious classes."""
    path = F.size("startup_path") > 0
    action = lambda p, c, d: F.struct(p.cast("int").alias("priority"), F.lit(c).alias("category"), d.alias("detail"))
    found = F.array_compact(
        F.array(
            F.when(path, action(F.lit(1), "startup_path", F.array_join("startup_path", " -> "))),
            F.when(F.size("unsupported") > 0, action(F.when(path, 2).otherwise(1), "unsupported_api", F.array_join("unsupported", ", "))),
            F.when((F.size("suspicious") > 0) & ~path, action(F.lit(2), "suspicious_class", F.array_join(F.slice("suspicious", 1, 5), ", "))),
            F.when(F.size("conditional") > 0, action(F.lit(3), "conditional_api", F.array_join("conditional", ", "))),
        )
    )
    found = F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(action(F.lit(4), "runtime_test", F.lit("no static blocker"))))
    rows = reports.withColumn("actions", found)
    first = F.col("actions")[0]
    return rows.withColumn("next_action", F.format_string("P%d · %s · %s", first["priority"], first["category"], first["detail"]))


def compare_reports(pairs: DataFrame) -> DataFrame:
    """Score change, APIs added and removed, and what changed, of pairs of structs ``left`` and ``right``."""
    left, right = F.col("left"), F.col("right")
    rank = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in K.STARTUP_RANK.items()], F.lit(1))
    diff = lambda a, b, f: F.array_sort(F.array_except(a[f], b[f]))
    return pairs.withColumns(
        {
            "score_delta": right["compatibility_score"] - left["compatibility_score"],
            "added_apis": diff(right, left, "detected_apis"),
            "removed_apis": diff(left, right, "detected_apis"),
            "added_unsupported": diff(right, left, "unsupported"),
            "removed_unsupported": diff(left, right, "unsupported"),
            "rank_delta": rank(right["startup_classification"]) - rank(left["startup_classification"]),
            "classification_changed": left["startup_classification"] != right["startup_classification"],
            "next_action_changed": left["next_action"] != right["next_action"],
        }
    )


def verdict(compared: DataFrame) -> DataFrame:
    """Adds verdict (IMPROVED, REGRESSED, MIXED, UNCHANGED), its reasons, and what is recommended."""
    delta, rank = F.col("score_delta"), F.col("rank_delta")
    good = F.array_compact(F.array(F.when(delta > 0, F.format_string("Compatibility score %+d", delta)), F.when(F.size("removed_unsupported") > 0, F.concat(F.lit("Unsupported APIs removed: "), F.array_join("removed_unsupported", ", "))), F.when(rank < 0, F.lit("Startup classification risk reduced"))))
    bad = F.array_compact(F.array(F.when(delta < 0, F.format_string("Compatibility score %+d", delta)), F.when(F.size("added_unsupported") > 0, F.concat(F.lit("Unsupported APIs added: "), F.array_join("added_unsupported", ", "))), F.when(rank > 0, F.lit("Startup classification risk increased"))))
    rows = compared.withColumns({"_good": good, "_bad": bad})
    label = F.when((F.size("_good") > 0) & (F.size("_bad") > 0), "MIXED").when(F.size("_good") > 0, "IMPROVED").when(F.size("_bad") > 0, "REGRESSED").otherwise("UNCHANGED")
    reasons = F.when(F.size(F.concat("_good", "_bad")) > 0, F.concat("_good", "_bad")).otherwise(F.array(F.lit("No material compatibility change detected")))
    score = F.format_string("Score delta %+d", delta)
    removed, added = F.array_join("removed_unsupported", ", "), F.array_join("added_unsupported", ", ")
    move = F.concat(F.col("left")["startup_classification"], F.lit(" -> "), F.col("right")["startup_classification"])
    advice = (
        F.when(label == "REGRESSED", F.when(F.size("added_unsupported") > 0, added).when(rank > 0, move).otherwise(score))
        .when(label == "IMPROVED", F.when(F.size("removed_unsupported") > 0, removed).when(rank < 0, move).otherwise(score))
        .when(label == "MIXED", F.when(F.size("added_unsupported") > 0, F.concat(added, F.when(F.size("removed_unsupported") > 0, F.concat(F.lit(" / "), removed)).otherwise(""))).otherwise(score))
        .otherwise("keep testing on the target")
    )
    return rows.withColumns({"verdict": label, "reasons": reasons, "recommendation": advice}).drop("_good", "_bad")


def font_risk(entries: DataFrame) -> DataFrame:
    """(archive_id, evidence, font_risk) from names and extensions of entries."""
    name, ext = F.lower(base_name("source")), extension("source")
    hinted = any_in(name, K.FONT_NAMES)
    points = F.when(ext.isin(*K.FONT_EXTENSIONS), 2).otherwise(0) + F.when(hinted, 1).otherwise(0) + F.when(hinted & ext.isin(*K.IMAGE_EXTENSIONS), 2).otherwise(0)
    got = entries.groupBy("archive_id").agg(F.sum(points).cast("int").alias("evidence"))
    return got.withColumn("font_risk", F.when(F.col("evidence") >= 3, "high").when(F.col("evidence") > 0, "medium").otherwise("low"))


def overall_risk(*risks: Column) -> Column:
    """The worst of several risks; unknown counts as medium."""
    rank = lambda c: F.when(c == "high", 2).when(c == "low", 0).otherwise(1)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.greatest(*[rank(c) for c in risks], F.lit(0)) + 1)


def findings(reports: DataFrame) -> DataFrame:
    """One row for each rule that fires (archive_id, category, severity), and an all-clear row where none does."""
    rule = lambda c, category, severity: F.when(c, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    uses = lambda a: F.array_contains("detected_apis", a)
    fired = [rule(uses("wma_sms"), "wma_sms", "high"), rule(uses("wma_sms"), "wma_policy", "medium")]
    fired += [rule(uses(a), a, "high" if cost == 18 else "medium" if cost == 8 else "low") for a, cost in K.API_COST.items() if a != "wma_sms"]
    rows = reports.withColumn("_f", F.array_compact(F.array(*fired)))
    clear = F.array(F.struct(F.lit("runtime").alias("category"), F.lit("low").alias("severity")))
    return rows.select("archive_id", F.explode(F.when(F.size("_f") > 0, F.col("_f")).otherwise(clear)).alias("f")).select("archive_id", "f.*")


def readiness(issues: DataFrame, archives: DataFrame) -> DataFrame:
    """BLOCKED, WARNING or READY for every archive from issues(archive_id, level, category)."""
    rank = F.when(F.col("level") == "BLOCKED", 2).when(F.col("level") == "WARNING", 1).otherwise(0)
    got = issues.groupBy("archive_id").agg(F.max(rank).alias("_r"), F.count(F.lit(1)).alias("issues"))
    rows = archives.select("archive_id").distinct().join(got, "archive_id", "left")
    return rows.select("archive_id", F.coalesce("issues", F.lit(0)).alias("issues"), F.when(F.col("_r") == 2, "BLOCKED").when(F.col("_r") == 1, "WARNING").otherwise("READY").alias("status"))


def glyph_coverage(required: DataFrame, mapped: DataFrame) -> DataFrame:
    """Per group of required(grp, ch): characters that mapped(ch) lacks, and the risk; no map at all is unknown."""
    any_map = F.broadcast(mapped.agg((F.count(F.lit(1)) > 0).alias("has_map")))  # one row
    rows = required.distinct().join(mapped.select("ch", F.lit(True).alias("_in")).distinct(), "ch", "left")
    lost = F.when(F.col("_in").isNull(), F.col("ch"))
    got = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("required"), F.array_join(F.array_sort(F.collect_set(lost)), "").alias("missing"), F.max(F.when(F.col("_in").isNull(), F.col("ch").rlike(r"[^\x00-\x7f]"))).alias("_wide"))
    risk = F.when(~F.col("has_map"), "unknown").when(F.col("_wide"), "high").when(F.col("_wide").isNotNull(), "medium").otherwise("low")
    return got.crossJoin(any_map).select("grp", "required", "missing", risk.alias("risk"))


def font_characters(descriptors: DataFrame, text: str = "text") -> DataFrame:
    """(source, ch, confidence): glyphs of font descriptors by the first form that gives any.

    95: ``char id=N``, or ``id=N`` where there is none; 82: a literal charset of four glyphs at least; 75: ``U+XXXX``,
    with numbers of two to six digits as well where the text speaks of characters.
    """
    char = lambda n, base: F.decode(F.unhex(F.lpad(F.conv(n, base, 16), 8, "0")), "UTF-32")
    numbers = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    valid = lambda least: lambda n: n.cast("long").between(least, 0x10FFFF)
    named = numbers(r"(?i)\bchar\s+id\s*=\s*(\d+)")
    ids = F.filter(F.when(F.size(named) > 0, named).otherwise(numbers(r"(?i)\bid\s*=\s*(\d+)")), valid(0))
    literal = F.btrim(F.regexp_extract(text, r"(?i)(?:chars?|charset)\s*[:=]\s*[\"']?([^\r\n\"']{4,})", 1))
    charset = F.filter(F.array_distinct(F.split(literal, "")), lambda x: (x != "") & ~x.rlike(SPACE))
    speaks = F.col(text).rlike(r"(?i)charset|glyph|char|codepoint|unicode")
    decimal = F.when(speaks, F.filter(numbers(r"(?<!\d)(\d{2,6})(?!\d)"), valid(32))).otherwise(_strings())
    points = F.concat(F.transform(numbers(r"U\+([0-9A-Fa-f]{2,6})"), lambda x: char(x, 16)), F.transform(decimal, lambda x: char(x, 10)))
    as_found = lambda chs, confidence: F.struct(chs.alias("chs"), F.lit(confidence).alias("confidence"))
    chosen = F.when(F.size(ids) > 0, as_found(F.transform(ids, lambda x: char(x, 10)), 95)).when(F.size(charset) >= 4, as_found(charset, 82)).when(F.size(points) > 0, as_found(points, 75))
    rows = descriptors.withColumn("_c", chosen).where("_c is not null")
    return rows.select("source", F.explode(F.array_distinct("_c.chs")).alias("ch"), F.col("_c.confidence").alias("confidence")).where("ch <> ''")


def required_characters(translations: DataFrame, group: str = "grp", text: str = "translation") -> DataFrame:
    """(group, ch): what the translations of each group are written in, white space aside; a group without any needs the fixed letters."""
    chars = translations.select(group, F.explode(F.array_distinct(F.split(text, ""))).alias("ch")).where((F.col("ch") != "") & ~F.col("ch").rlike(SPACE)).distinct()
    silent = translations.select(group).distinct().join(chars.select(group).distinct(), group, "left_anti")
    return chars.unionByName(silent.select(group, F.explode(F.split(F.lit(K.VIETNAMESE), "")).alias("ch")).where("ch <> ''"))


def missing_glyphs(required: DataFrame, mapped: DataFrame) -> DataFrame:
    """The required(grp, ch) that no font descriptor maps."""
    return required.join(mapped.select("ch").distinct(), "ch", "left_anti").select("grp", "ch")


def profile_intersection(apis: Column, profile: Column, support: str) -> Column:
    """The APIs that a profile supports so, sorted; a profile that is not known counts as the generic one."""
    sets = {p: F.array(*[F.lit(a) for a in kinds[support]]) for p, kinds in K.PROFILES.items()}
    known = F.coalesce(*[F.when(profile == p, s) for p, s in sets.items()], sets["generic_j2me"])
    return F.array_sort(F.array_intersect(apis, known))


def bounded(items: Column | str, most: int, none: str = "") -> Column:
    """The first of a list for a message, or what is said where there is none."""
    return F.coalesce(F.array_join(F.slice(items, 1, most), ", "), F.lit(none))


def cut(text: Column, most: int = 140) -> Column:
    """A text of at most so many characters, with dots where more would follow."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def _titled(c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in K.STARTUP_TITLES.items()])


def diagnostic_summaries(reports: DataFrame, target: str = "FreeJ2ME / RG35XX") -> DataFrame:
    """Adds action_label and summary, a short text of a report's findings; reports: those of recommended_actions with a name."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ", ")).otherwise("none")
    top = F.col("actions")[0]
    label = F.concat(F.lit("P"), top["priority"].cast("string"), F.lit(" · "), _titled(top["category"]), F.when(top["detail"] != "", F.concat(F.lit(" · "), top["detail"])).otherwise(""))
    lines = {
        "JAR": F.col("name"), "Target": F.lit(target), "Runtime": F.concat(F.col("compatibility_score").cast("string"), F.lit("/100 · "), F.upper("runtime_risk")),
        "Assessment": F.concat(_titled(F.col("startup_classification")), F.lit(" · "), F.upper("startup_severity")), "Detected APIs": listed("detected_apis"), "Unsupported APIs": listed("unsupported"),
        "Conditional APIs": listed("conditional"), "Startup path": F.when(F.size("startup_path") > 0, F.array_join("startup_path", " -> ")).otherwise("not found"), "Next action": label,
    }
    return reports.withColumns({"action_label": label, "summary": F.concat_ws("\n", F.lit("JAR RG35XX DIAGNOSTIC SUMMARY"), *[F.concat(F.lit(f"{k}: "), v) for k, v in lines.items()])})


def activation_findings(reports: DataFrame) -> DataFrame:
    """(archive_id, category, severity) of activation reports: suspicious classes, their link to messaging, their reach from the start; has_roots: the entry classes are known."""
    reachable = F.col("activation_reachable") | F.col("payment_reachable")
    found = F.array_compact(
        F.array(
            _finding(F.col("classes") > 0, "activation", F.col("flow_risk")),
            _finding(F.col("wma_linked"), "wma_link", F.lit("high")),
            _finding(reachable | ((F.col("classes") > 0) & F.col("has_roots")), "startup_path", F.when(reachable, "high").otherwise("medium")),
        )
    )
    return reports.select("archive_id", F.explode(found).alias("f")).select("archive_id", "f.*")


def _finding(condition: Column, category: str, severity: Column) -> Column:
    return F.when(condition, F.struct(F.lit(category).alias("category"), severity.alias("severity")))


def encoding_findings(entries: DataFrame, translations: DataFrame) -> DataFrame:
    """(archive_id, category, severity): low for an entry that names an encoding, high for a translation(archive_id, source, codec, translation) that its
    charset can't hold, medium for an archive with letters beyond ASCII where neither is so."""
    marked = entries.where(extension("source").isin(*K.MARKED_EXTENSIONS) & any_in(F.lower("content"), K.ENCODING_MARKERS)).select("archive_id")
    bad = translations.where(~F.lower("codec").isin("utf-8", "utf8") & ~encodable("translation", "codec")).select("archive_id")
    open_ = translations.where(F.col("translation").rlike(r"[^\x00-\x7f]")).select("archive_id").distinct().join(marked.unionByName(bad).distinct(), "archive_id", "left_anti")
    told = lambda df, severity: df.select("archive_id", F.lit("encoding").alias("category"), F.lit(severity).alias("severity"))
    return told(marked, "low").unionByName(told(bad, "high")).unionByName(told(open_, "medium"))


def readiness_issues(reports: DataFrame) -> DataFrame:
    """(archive_id, level, category): every issue of archives before a build.

    reports: assessed rows with strings, translated and unsafe (counts, null: none), overall_risk and actions.
    """
    issue = lambda level, category: F.struct(level.alias("level"), F.lit(category).alias("category"))
    if_so = lambda c, category: F.when(c, issue(F.lit("WARNING"), category))
    either = lambda c, category: issue(F.when(c, "WARNING").otherwise("INFO"), category)
    strings, translated = F.coalesce("strings", F.lit(0)), F.coalesce("translated", F.lit(0))
    unsupported, conditional = F.size("unsupported") > 0, F.size("conditional") > 0
    found = F.array_compact(
        F.array(
            issue(F.when((strings == 0) | (translated == 0), "BLOCKED").when(translated < strings, "WARNING").otherwise("INFO"), "translation"),
            if_so(F.coalesce("unsafe", F.lit(0)) > 0, "binary"),
            either(F.col("overall_risk").isin("high", "medium"), "compatibility"),
            if_so(unsupported, "runtime"),
            if_so(conditional, "runtime"),
            either(unsupported | conditional, "runtime"),
            if_so(F.array_contains("detected_apis", "wma_sms"), "wma_sms"),
            either(F.col("flow_risk") != "low", "activation"),
            either(F.col("startup_severity").isin("medium", "high"), "startup_assessment"),
            either(F.col("actions")[0]["priority"] <= 2, "recommended_action"),
        )
    )
    return reports.select("archive_id", F.explode(found).alias("i")).select("archive_id", "i.*")
