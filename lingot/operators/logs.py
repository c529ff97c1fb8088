"""Runtime logs: classification of lines, exception events, correlation with compatibility reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import any_in, forward_slashes
from ..plans.scratch import kept


def classify_lines(log: DataFrame) -> DataFrame:
    """Adds token, severity, category by the first rule that matches, class_name and resource; other lines go.

    Works on streams as well: every column is a function of the line.
    """
    low = F.lower(F.trim("line"))
    rule = F.lit(None).cast("struct<token:string,severity:string,category:string>")
    as_rule = lambda t, s, c: F.struct(F.lit(t).alias("token"), F.lit(s).alias("severity"), F.lit(c).alias("category"))
    for token, severity, category in reversed([*K.LOG_RULES]):
        rule = F.when(low.contains(token.lower()), as_rule(token, severity, category)).otherwise(rule)
    rule = F.coalesce(rule, F.when(any_in(low, K.FAILURE_WORDS), as_rule("runtime-failure", "HIGH", "runtime")).when(any_in(low, K.WARNING_WORDS), as_rule("warning", "MEDIUM", "runtime")))
    rows = log.withColumn("_rule", rule).where("_rule is not null").select(*log.columns, "_rule.*")
    resource = forward_slashes(F.regexp_extract("line", K.RESOURCE_IN_LOG, 1))
    return rows.withColumn("class_name", F.translate(F.regexp_extract("line", K.CLASS_IN_LOG, 1), ".", "/")).withColumn("resource", resource)


def log_status(issues: DataFrame, group: str = "log_id") -> DataFrame:
    """FAIL with any severe issue, else WARNING with any other, else PASS."""
    got = issues.groupBy(group).agg(F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(F.col("severity") == "MEDIUM").alias("medium"))
    return got.withColumn("status", F.when(F.col("high") > 0, "FAIL").when(F.col("medium") > 0, "WARNING").otherwise("PASS"))


def frequencies(issues: DataFrame) -> DataFrame:
    """Counts by token, class and resource in one pass; most frequent first."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("token", "class_name", "resource")])).alias("k")
    return issues.select(kinds).select("k.*").where("name <> ''").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", F.desc("n"), "name")


#: Characters of a needle that are joined before the whole needle is looked for.
_ANCHOR = 8
#: Rows of sources, which were counted, that are broadcast at most.
BROADCAST_ROWS = 100_000


def _runs(text: str, lengths: list[int]) -> Column:
    """The different runs of so many characters of a text; none of a null one."""
    size = F.char_length(text)
    run_at = lambda n: lambda i: F.substr(F.col(text), i, F.lit(n))
    found = [F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), run_at(n))) for n in lengths]
    return F.array_distinct(F.flatten(F.array_compact(F.array(F.array().cast("array<string>"), *found))))


def _name_anchors(paths: DataFrame) -> DataFrame:
    """(_name, _rarest): of every name of _ANCHOR characters and more the run of so many that fewest names have, so that names that begin alike part."""
    names = paths.select("_name").where(F.char_length("_name") >= _ANCHOR).distinct()
    runs = names.select("_name", F.explode(_runs("_name", [_ANCHOR])).alias("_run"))
    rarity = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    least = runs.join(rarity, "_run").groupBy("_name").agg(F.min(F.struct("_n", "_run")).alias("_least"))
    return least.select("_name", F.col("_least._run").alias("_rarest"))


def patched_sources(issues: DataFrame, sources: DataFrame) -> DataFrame:
    """issues x sources(path) where the resource or class is in the path, or the path or its base name in the line.

    One equality join on eight characters of what is looked for (fewer only where it is shorter) and all
    such runs of what it is looked for in: base names, by their rarest run, in lines (rule 0; a line that holds a path holds its base name),
    resources and class names, by their first characters, in paths (1, 2).  The whole is tested on what meets, and a pair stays with its first rule,
    so rows that repeat stay as often as they are.  Nulls hold nothing; an empty base name is in every line.
    """
    paths = sources.withColumn("_path", F.lower("path")).withColumn("_name", F.element_at(F.split("_path", "/"), -1))
    paths = paths.join(_name_anchors(paths), "_name", "left").withColumn("_anchor", F.coalesce("_rarest", "_name")).drop("_rarest")
    told = F.when(F.col("class_name") != "", F.concat(F.lower(F.element_at(F.split("class_name", "/"), -1)), F.lit(".class")))
    rows = issues.withColumns({"_line": F.lower("line"), "_resource": F.when(F.col("resource") != "", F.lower("resource")), "_class": told})
    at = lambda rule: lambda run: F.struct(F.lit(rule).alias("_rule"), run.alias("_run"))
    anchor = lambda rule, needle: F.when(F.col(needle).isNotNull(), at(rule)(F.substring(needle, 1, _ANCHOR)))
    lengths = sorted(r[0] for r in paths.where("_name is not null").select(F.least(F.char_length("_name"), F.lit(_ANCHOR))).distinct().collect())  # nine numbers at most
    of_issue = F.concat(F.transform(_runs("_line", lengths), at(0)), F.array(anchor(1, "_resource"), anchor(2, "_class")))
    of_path = F.concat(F.array(anchor(0, "_anchor")), F.transform(_runs("_path", [*range(1, _ANCHOR + 1)]), at(1)), F.transform(_runs("_path", [*range(len(".class"), _ANCHOR + 1)]), at(2)))
    paths = kept(paths.select("*", F.inline(F.array_compact(of_path))), "patched-paths")
    rows = rows.select("*", F.inline(F.array_compact(of_issue)))
    # lines are many times what their table is, so they are never the side that goes to the driver
    few = paths.count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(paths), ["_rule", "_run"]) if few else rows.hint("merge").join(paths, ["_rule", "_run"])
    by_name, by_resource = F.contains(F.col("_line"), F.col("_name")), F.contains(F.col("_path"), F.col("_resource"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    by_class = F.endswith(F.col("_path"), F.col("_class"))
    first = F.when(F.col("_rule") == 0, by_name).when(F.col("_rule") == 1, by_resource & no(by_name)).otherwise(by_class & no(by_name) & no(by_resource))
    return met.where(first).select(*issues.columns, *sources.columns)


def error_type(line: Column) -> Column:
    return F.coalesce(*[F.when(line.contains(t), F.lit(t)) for t in K.ERROR_TYPES])


def tail_of(line: Column, token: Column) -> Column:
    """What follows the first occurrence of a token, without leading colons and spaces."""
    return F.ltrim(F.substr(line, F.position(token, line) + F.char_length(token)), F.lit(": "))


def symbol(line: Column, token: Column) -> Column:
    """The word after an error type, with dots for slashes."""
    return F.translate(F.regexp_extract(tail_of(line, token), r"^([^\s;,]*)", 1), "/", ".")


def api_hint(text: Column) -> Column:
    dotted = F.lower(F.translate(text, "/", "."))
    return F.coalesce(*[F.when(dotted.contains(prefix), F.lit(api)) for prefix, api in K.API_HINTS], F.lit(""))


def stack_frame(line: Column) -> Column:
    """The class of a stack frame; empty for other lines."""
    return F.regexp_extract(line, K.STACK_FRAME, 1)


def events(log: DataFrame) -> DataFrame:
    """One row per exception event of a log: number, type, message, cause flag, stack frames in order, severity.

    A header line opens an event and the frames below it are its own; frames before the first header go.
    """
    order = Window.partitionBy("log_id").orderBy("line_no")
    kind = error_type(F.col("line"))
    rows = log.withColumn("error_type", kind).withColumn("event", F.sum(F.when(kind.isNotNull(), 1).otherwise(0)).over(order) - 1)
    text = F.trim("line")
    caused = text.startswith("Caused by:")
    rows = rows.where("event >= 0").withColumn("frame", F.when(F.col("error_type").isNull(), F.translate(stack_frame(F.col("line")), "/", ".")))
    header = F.struct("error_type", tail_of(text, F.col("error_type")).alias("message"), caused.alias("caused_by"))
    got = rows.groupBy("log_id", "event").agg(
        F.min_by(header, "line_no").alias("h"),
        F.array_sort(F.collect_list(F.when(F.col("frame") != "", F.struct("line_no", "frame")))).alias("f"),
    )
    severity = F.when(F.col("h.error_type").isin(*K.SEVERE_TYPES), "high").otherwise("medium")
    return got.select("log_id", F.col("event").cast("int").alias("event"), "h.error_type", "h.message", "h.caused_by", F.array_distinct(F.col("f.frame")).alias("frames"), severity.alias("severity"))


def scored_events(events: DataFrame, reports: DataFrame) -> DataFrame:
    """Adds the overlap with a log's startup_path and detected_apis, and a score; reports: one row per log_id."""
    rows = events.join(reports, "log_id", "left").withColumns({"startup_path": F.coalesce("startup_path", F.array().cast("array<string>")), "detected_apis": F.coalesce("detected_apis", F.array().cast("array<string>"))})
    startup = F.filter(F.transform("startup_path", lambda x: F.translate(x, "/", ".")), lambda x: F.array_contains("frames", x))
    seen = api_hint(F.concat_ws(" ", "message", F.array_join("frames", " ")))
    apis = F.when(F.array_contains("detected_apis", seen), F.array(seen)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"startup_overlap": startup, "api_overlap": apis})
    score = F.when(F.col("caused_by"), 100).otherwise(0) + F.when(F.col("severity") == "high", 60).otherwise(20) + 25 * F.size("startup_overlap") + 20 * F.size("api_overlap") + F.col("event")
    return rows.withColumn("score", score.cast("int"))


def timeline(scored: DataFrame) -> DataFrame:
    """Per log the root event (the last that was caused by another, else the first) and the primary one (best score, first on ties)."""
    caused = F.max(F.when(F.col("caused_by"), F.col("event")))
    best = F.max_by(F.struct("event", "error_type", "startup_overlap"), F.struct("score", -F.col("event")))
    got = scored.groupBy("log_id").agg(F.coalesce(caused, F.lit(0)).alias("root_event"), best.alias("p"), F.count(F.lit(1)).cast("int").alias("exceptions"), F.count_if(F.col("severity") == "high").cast("int").alias("high"), F.map_from_entries(F.collect_list(F.struct("event", "error_type"))).alias("types"))
    return got.select("log_id", "root_event", F.element_at("types", F.col("root_event")).alias("root_exception"), F.col("p.event").alias("primary_event"), F.col("p.error_type").alias("primary_exception"), F.col("p.startup_overlap").alias("primary_startup"), "exceptions", "high")


def findings(log: DataFrame) -> DataFrame:
    """Distinct (error type, symbol, line) of each log in order of first sight, with API hint and severity."""
    text = F.trim("line")
    rows = log.withColumn("line", text).select("log_id", "line_no", "line", F.explode(F.array(*[F.lit(t) for t in K.ERROR_TYPES])).alias("error_type")).where(F.col("line").contains(F.col("error_type")))
    rows = rows.withColumn("symbol", symbol(F.col("line"), F.col("error_type"))).withColumn("api_hint", api_hint(F.concat_ws(" ", "line", "symbol")))
    first = rows.groupBy("log_id", "error_type", "symbol", "line").agg(F.min("line_no").alias("line_no"), F.first("api_hint").alias("api_hint"))
    return first.withColumn("severity", F.when(F.col("error_type").isin(*K.SEVERE_TYPES), "high").otherwise("medium"))


def correlate(log: DataFrame, reports: DataFrame) -> DataFrame:
    """Per log: findings, frames, matched APIs and startup classes, the path that probably failed, and its cause."""
    empty = F.array().cast("array<string>")
    found = findings(log)
    missing = F.col("error_type").isin("ClassNotFoundException", "NoClassDefFoundError")
    has = lambda t: F.bool_or(F.col("error_type") == t)
    order = F.struct("line_no", F.array_position(F.array(*[F.lit(t) for t in K.ERROR_TYPES]), F.col("error_type")))
    sums = found.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.array_sort(F.collect_set(F.when(F.col("api_hint") != "", F.col("api_hint")))).alias("hints"),
        F.bool_or(missing).alias("missing"),
        F.min_by(F.when(missing & (F.col("symbol") != ""), F.col("symbol")), F.when(missing & (F.col("symbol") != ""), order)).alias("missing_symbol"),
        has("VerifyError").alias("verify"),
        has("UnsupportedOperationException").alias("unsupported"),
        has("OutOfMemoryError").alias("memory"),
        F.min_by("error_type", order).alias("first_type"),
    )
    frame = F.translate(stack_frame(F.col("line")), "/", ".")
    frames = log.withColumn("frame", frame).where("frame <> ''").groupBy("log_id").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("line_no", "frame"))).getField("frame")).alias("frames"))
    rows = log.select("log_id").distinct().join(sums, "log_id", "left").join(frames, "log_id", "left").join(reports, "log_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in ("hints", "frames", "startup_path", "detected_apis")})
    apis = F.when(F.size("detected_apis") == 0, F.col("hints")).otherwise(F.array_intersect("hints", "detected_apis"))
    startup = F.filter(F.transform("startup_path", lambda x: F.translate(x, "/", ".")), lambda x: F.array_contains("frames", x))
    rows = rows.withColumns({"matched_apis": apis, "matched_startup": startup})
    own = F.filter("frames", lambda x: ~x.rlike(r"^(?:java|javax|sun|com\.sun)\."))
    path = F.array_distinct(F.concat("matched_startup", F.reverse(own), F.slice("matched_apis", 1, 1)))
    cause = (
        F.when(F.col("missing"), F.concat(F.lit("Runtime cannot resolve required class: "), F.coalesce("missing_symbol", F.lit("required class"))))
        .when(F.col("verify"), "Bytecode verification failed on the target runtime")
        .when(F.col("unsupported"), "A runtime operation is present but unsupported by the target environment")
        .when(F.col("memory"), "The runtime ran out of memory during execution")
        .when(F.col("findings") > 0, F.concat(F.lit("Runtime exception detected: "), F.col("first_type")))
        .otherwise("No high-confidence runtime failure detected")
    )
    return rows.select("log_id", F.coalesce("findings", F.lit(0)).cast("int").alias("findings"), "frames", "matched_apis", "matched_startup", path.alias("failing_path"), cause.alias("probable_cause"))


def diagnose(log: DataFrame, reports: DataFrame) -> DataFrame:
    """correlate and timeline side by side: one diagnosis per log."""
    found = correlate(log, reports)
    told = timeline(scored_events(events(log), reports))
    rows = found.join(told, "log_id", "left")
    overlap = F.when(F.size(F.coalesce("primary_startup", F.array().cast("array<string>"))) > 0, F.col("primary_startup")).otherwise(F.col("matched_startup"))
    none = F.lit("none")
    return rows.select("log_id", "probable_cause", F.coalesce("primary_exception", none).alias("primary_exception"), F.coalesce("root_exception", none).alias("root_exception"), "failing_path", "matched_apis", overlap.alias("startup_overlap"), F.coalesce("exceptions", F.lit(0)).alias("exceptions"), F.coalesce("high", F.lit(0)).alias("high"))


def history(entries: DataFrame, owner: str, path: list[str], newest: list[str], most: int = 10) -> DataFrame:
    """entries with place: per owner the ``most`` newest, the first by 1, and of one path only the newest.

    The newest of a path is a maximum, which is summed before it is shuffled; then an owner has one row for each path.
    """
    rest = [c for c in entries.columns if c not in (owner, *path)]
    latest = entries.groupBy(owner, *path).agg(F.max(F.struct(*newest, *[c for c in rest if c not in newest])).alias("_e")).select(owner, *path, "_e.*")
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*[F.desc(c) for c in newest]))
    return latest.withColumn("place", place).where(F.col("place") <= most).select(*entries.columns, "place")
