"""Which strings are language that a player reads: a score of weighted rules, and its threshold by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .text import any_in, count_of, entropy, label_form, letter_count, normal_space, script_count, word_tokens

Rule = tuple[Column, int | Column, str | None]


def shape(c: Column, name: str) -> Column:
    return c.rlike(K.SHAPES[name])


#: Characters of the longest text that is judged.
LONGEST = 800


def _prepared(df: DataFrame, value: str, source: str, kind: str, normal: str | None) -> DataFrame:
    s = F.coalesce(F.col(normal) if normal else normal_space(value), F.lit(""))
    # a text that is too long is not measured
    out = settled(df.withColumn("_s", s).withColumn("_n", F.char_length("_s")).withColumn("_s", F.when(F.col("_n") <= LONGEST, F.col("_s")).otherwise("")), "_s", "_n")
    out = out.withColumn("_kind", F.coalesce(F.col(kind), F.lit(""))).withColumn("_path", F.lower(F.coalesce(F.col(source), F.lit(""))))
    out = out.withColumn("_raw", F.coalesce(F.col(value), F.lit("")))
    return out.withColumns(
        {
            "_low": F.lower("_s"), "_words": word_tokens("_s"), "_label": label_form("_s"),
            "_letters": letter_count("_s"), "_digits": count_of(F.col("_s"), r"\p{Nd}"),
            "_spaces": F.char_length("_s") - F.char_length(F.replace(F.col("_s"), F.lit(" "), F.lit(""))), "_punct": count_of(F.col("_s"), r"[^\p{L}\p{N} ]"), "_cjk": script_count("_s"),
        }
    )


def _rules() -> list[Rule]:
    """(condition, weight, reason) in the order in which reasons are given."""
    s, low, kind, path, n = F.col("_s"), F.col("_low"), F.col("_kind"), F.col("_path"), F.col("_n")
    words, cjk, spaces, label = F.size("_words"), F.col("_cjk"), F.col("_spaces"), F.col("_label")
    ui, label_ui = low.isin(*K.UI_WORDS), label.isin(*K.UI_WORDS)
    in_class, binary = kind.startswith("class-string"), kind.startswith("binary:")
    odd = count_of(s, r"[\\\[\]{}<>`|^~]")
    chunks = count_of(low, "nlv") + count_of(low, "vxi") + count_of(low, "ian")
    lower = (s == low) & s.rlike(r"\p{Ll}")
    upper = (s == F.upper(s)) & s.rlike(r"\p{Lu}")
    title = s.rlike(r"^(?:[^\p{L}]*\p{Lu}\p{Ll}*)+[^\p{L}]*$")
    hints = F.size(F.filter("_words", lambda w: F.lower(w).isin(*K.HINT_WORDS)))
    numeric = ~label_ui & shape(s, "numeric_label")
    technical = ~label_ui & ~numeric & label.isin(*K.TECHNICAL_WORDS) & (words == 1)
    short = (n >= 1) & (n <= 4)
    short_display = ~label_ui & s.rlike(r"^\p{L}+$") & (upper | title)
    alpha = F.col("_letters") / F.greatest(F.lit(1), n)
    # shapes that no text with a space has: one look for a space instead of a dozen patterns
    lone = lambda name: ~s.contains(" ") & shape(s, name)
    return [
        (F.col("_raw").contains("\x00"), -35, "embedded NUL"),
        (shape(s, "url"), -80, "URL/protocol"),
        (s.contains("@") & lone("email"), -70, "email"),
        (shape(s, "descriptor"), -100, "Java descriptor"),
        (lone("uuid") | lone("hex"), -80, "hash/id"),
        (s.startswith("<") & shape(s, "markup"), -70, "XML/markup element"),
        (lone("mime"), -65, "MIME type"),
        (lone("package"), -70, "package/class name"),
        (lone("path"), -65, "path"),
        (lone("path_fragment"), -85, "path fragment"),
        (lone("metadata_key"), -90, "MIDlet metadata key"),
        (lone("file_name"), -55, "filename"),
        (s.startswith("%") & shape(s, "printf"), -60, "format token only"),
        (lone("constant") & ~ui, -55, "constant identifier"),
        (lone("snake_case") & ~ui, -50, "snake_case identifier"),
        (lone("camel_case") & (n >= 6) & ~ui, -42, "camelCase identifier"),
        (in_class & lone("engine_token"), -85, "prefixed engine token"),
        (in_class & lone("bracket_command"), -70, "script command token"),
        (in_class & low.isin(*K.SCRIPT_WORDS) & ~ui, -58, "engine/script command"),
        (binary & shape(s, "command_script"), -100, "binary command script"),
        (binary & (cjk == 0) & s.contains("\x7f"), -120, "binary control byte in ASCII payload"),
        (binary & (cjk == 0) & shape(s, "printable_ascii") & (spaces == 0) & (n >= 5) & ((odd >= 1) | (chunks >= 2)), -95, "random-looking ASCII binary payload"),
        (any_in(low, K.PLATFORM_REFERENCES), -90, "platform/internal reference"),
        (in_class & (cjk == 0) & lone("identifier") & lower & ~ui & ~low.isin(*K.HINT_WORDS), -45, "lowercase class identifier"),
        (in_class & (cjk == 0) & lone("upper_camel") & ~ui, -55, "class/type identifier"),
        (cjk >= 2, 34, "CJK language text"),
        ((cjk >= 2) & (cjk / F.greatest(F.lit(1), n) >= 0.45), 12, None),
        ((cjk >= 2) & n.between(2, 12), 8, None),
        (label_ui, 90, "known game UI label"),
        (numeric, 60, "game UI numeric label"),
        (technical, -48, "common code/method token"),
        (any_in(path, K.PATH_HINTS), 22, "language-like source path"),
        (any_in(path, K.CODE_PATHS), -12, "technical source path"),
        (words >= 2, 24, "multi-word phrase"),
        (words >= 4, 12, "sentence-like phrase"),
        (hints > 0, F.least(F.lit(24), hints * 6), "natural-language word hits"),
        (spaces > 0, 8, None),
        (F.right(s, F.lit(1)).isin(*".!?…"), 9, "sentence punctuation"),
        ((words == 1) & n.between(2, 20) & (F.get("_words", F.lit(0)) == s) & (lower | upper | title), 14, "display-word shape"),
        (short & label_ui, 20, None),
        (short & short_display, 6, None),
        (short & ~label_ui & ~short_display, -12, None),
        (alpha >= 0.65, 10, None),
        (alpha < 0.30, -28, "low alphabetic ratio"),
        (F.col("_digits") / F.greatest(F.lit(1), n) > 0.45, -25, "digit-heavy"),
        ((F.col("_punct") / F.greatest(F.lit(1), n) > 0.30) & (spaces == 0), -22, "punctuation-heavy"),
        (F.when((n >= 12) & (spaces == 0) & (words <= 1), entropy(s) >= 4.0).otherwise(False), -22, "high-entropy token"),
        (in_class, 5, None),
        (kind.startswith("deep-"), -8, None),
        (binary & kind.endswith(":safe"), 4, None),
    ]


def classify(df: DataFrame, value: str = "value", source: str = "source", kind: str = "kind", normal: str | None = None) -> DataFrame:
    """Adds score and reasons (in rule order) for every row; a text without letters or over 800 characters scores -100.

    ``normal``: the column that holds the value's ``normal_space`` already.
    """
    rules = _rules()
    out = _prepared(df, value, source, kind, normal)
    # two projections: rule columns first, so that no generated method gets too long
    out = out.withColumns({f"_r{i}": c for i, (c, _, _) in enumerate(rules)})
    score = F.lit(0)
    for i, (_, weight, _) in enumerate(rules):
        score = score + F.when(F.col(f"_r{i}"), weight if isinstance(weight, Column) else F.lit(weight)).otherwise(0)
    said = F.filter(F.array(*[F.when(F.col(f"_r{i}"), F.lit(r)) for i, (_, _, r) in enumerate(rules) if r]), lambda x: x.isNotNull())
    empty = (F.col("_n") == 0) | (F.col("_n") > LONGEST)
    out = out.withColumn("score", F.when(empty, -100).when(F.col("_letters") == 0, -100).when(shape(F.col("_s"), "extension"), -100).otherwise(score).cast("int"))
    lone = lambda r: F.array(F.lit(r))
    out = out.withColumn("reasons", F.when(empty, lone("empty/too long")).when(F.col("_letters") == 0, lone("no letters")).when(shape(F.col("_s"), "extension"), lone("bare file extension token")).otherwise(said))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns as values that later filters read: a filter on an expression would be evaluated in its place once more for each use."""
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def threshold(kind: Column) -> Column:
    """The least score that is accepted for a kind of string."""
    return F.when(kind.startswith("deep-binary"), 28).when(kind.startswith("deep-text"), 18).when(kind.startswith("class-string"), 12).otherwise(14)
