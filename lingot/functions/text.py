"""Column functions over text: normal forms, measures, placeholders, paths, repair of wrongly decoded text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

#: One valid multi-byte UTF-8 sequence, or any other byte, of bytes that are read as Latin-1.
UNIT = r"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|[\s\S]"
#: White space that is no plain space; what lies beyond ASCII is told by one range first.
ODD_SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
SPACE = f"[ {ODD_SPACE}]"
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:'[\p{L}\p{Nl}\p{No}]+)?"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def normal_space(c: Column | str) -> Column:
    """White space collapsed to single spaces and stripped."""
    # a space alone stays as it is, so that most texts have nothing to replace
    return F.btrim(F.regexp_replace(as_column(c), f"{ODD_SPACE}{SPACE}*| {SPACE}+", " "), F.lit(" "))


def stripped(c: Column | str) -> Column:
    """A text without white space around it."""
    s = as_column(c)
    return F.when(F.concat(F.left(s, F.lit(1)), F.right(s, F.lit(1))).rlike(SPACE), F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")).otherwise(s)


def digest(c: Column | str) -> Column:
    """128 bits of the SHA-256 of a text, that stand for it where it is only compared; null for null."""
    return F.substring(F.unhex(F.sha2(as_column(c), 256)), 1, 16)


def label_form(c: Column | str) -> Column:
    """Lower case without surrounding punctuation, as labels are looked up."""
    return F.btrim(F.lower(as_column(c)), F.lit(K.LABEL_STRIP))


def word_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(WORD), F.lit(0))


def several_words(c: Column | str) -> Column:
    """Whether a text has two or more ``word_tokens``; looks no further than the second."""
    letters = r"[\p{L}\p{Nl}\p{No}]"
    return as_column(c).rlike(rf"(?s)(?<!{letters}){letters}++(?:'{letters}++)?+.*?{letters}")


def entropy(c: Column | str) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    s = as_column(c)
    # sorted characters stand in runs of equal ones: one pass over a text of any length
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(s, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    share = F.transform(runs, lambda x: F.char_length(x) / F.char_length(s))
    return F.when(F.char_length(s) > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def letter_count(c: Column | str) -> Column:
    """Letters; what is left without the runs of other characters are far fewer matches than letters."""
    return F.char_length(F.regexp_replace(as_column(c), r"[^\p{L}]+", ""))


def script_count(c: Column | str) -> Column:
    s = as_column(c)
    return F.when(s.rlike(r"[\x{3040}-\x{faff}]"), count_of(s, K.CJK)).when(s.isNotNull(), 0)  # one range holds all of them


def quality_score(c: Column | str) -> Column:
    """How much a text looks well decoded: shares of printable, letters, CJK less controls, U+FFFD, mojibake and NUL."""
    s = as_column(c)
    n = F.char_length(s).cast("double")
    share = lambda pattern: count_of(s, pattern) / n
    printable = share(r"[^\p{C}\p{Zl}\p{Zp}\p{Zs}]|[ \t\r\n]")
    score = printable * 1.2 + share(r"\p{L}") * 0.6 + share(K.CJK) * 0.9 - share(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") * 1.7
    score = score - share(r"\x{fffd}") * 3.0 - share(K.MOJIBAKE) * 0.9 - share(r"\x00") * 1.2
    return F.when(n > 0, score).otherwise(-10.0)


#: Where cp1252 differs from Latin-1: its characters and the bytes they stand for.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CP1252_BYTES = "".join(chr(c.encode("cp1252")[0]) for c in _CP1252)


def repair_mojibake(c: Column | str) -> Column:
    """UTF-8 that was read as Latin-1 or cp1252, read again, where that scores clearly better; else the text."""
    s = as_column(c)

    def again(raw: Column) -> Column:
        data = F.when(raw.rlike(r"^[\x{0}-\x{ff}]*$"), F.encode(raw, "ISO-8859-1"))
        return F.try_validate_utf8(data.cast("string"))

    first, second = again(s), again(F.translate(s, _CP1252, _CP1252_BYTES))
    base = quality_score(s)
    better = lambda x, than: F.coalesce(quality_score(x) > than + 0.08, F.lit(False))
    chosen = F.when(better(first, base), first).otherwise(F.when(better(second, base), second).otherwise(s))
    return F.when(s.rlike(K.MOJIBAKE), chosen).otherwise(s)


def placeholders(c: Column | str) -> Column:
    """Sorted placeholders, repeats kept; most texts have no character with which one begins."""
    s = as_column(c)
    found = F.array_sort(F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(0)) for p in K.PLACEHOLDERS]))
    return F.when(~s.rlike(r"[%{\\<]"), F.array().cast("array<string>")).otherwise(found)


def placeholders_preserved(original: Column | str, translated: Column | str) -> Column:
    return placeholders(original) == placeholders(translated)


def extension(path: Column | str) -> Column:
    """Lower-case extension without the dot of the last part of a path; empty without one."""
    return F.lower(F.regexp_extract(as_column(path), r"\.([^./\\]*)$", 1))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(as_column(path), r"([^/\\]*)$", 1)


def forward_slashes(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(as_column(path), r"\\", "/"), "^/+", "")


def class_name(entry: Column | str) -> Column:
    """a/b/C.class -> a.b.C"""
    return F.translate(F.regexp_replace(forward_slashes(entry), r"(?i)\.class$", ""), "/", ".")


def endpoints(c: Column | str, scheme: str = "sms") -> Column:
    """Distinct printable endpoints of a scheme, at most 160 characters; hits within hits count."""
    s = as_column(c)
    pieces = F.split(s, rf"(?i)(?={scheme}://)")
    hits = F.filter(pieces, lambda x: x.rlike(rf"(?i)^{scheme}://"))
    # a hit runs on through later ones while characters stay printable, so each starts from its own place
    starts = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.array_join(F.slice(pieces, i + 1, F.size(pieces)), ""))
    runs = F.transform(F.filter(starts, lambda x: x.rlike(rf"(?i)^{scheme}://")), lambda x: F.regexp_extract(x, r"^([\x20-\x7e]{1,160})", 1))
    return F.when(F.size(hits) > 0, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<string>"))


def safe_name(c: Column | str, default: str = "unnamed") -> Column:
    cleaned = F.btrim(F.regexp_replace(as_column(c), r"[^\p{L}\p{N}\-_.]", "_"), F.lit("._"))
    return F.when(cleaned == "", default).otherwise(cleaned)


def structural_bytes(data: Column) -> Column:
    """True where bytes are not UTF-8 or hold a control other than TAB, LF and CR."""
    valid = F.is_valid_utf8(data.cast("string"))
    return ~valid | F.decode(data, "ISO-8859-1").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def mixed_islands(data: Column) -> Column:
    """Bytes as text: valid multi-byte UTF-8 sequences decoded, every other byte as the Latin-1 character."""
    latin = F.decode(data, "ISO-8859-1")
    parts = F.regexp_extract_all(latin, F.lit(UNIT), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(F.char_length(x) > 1, F.encode(x, "ISO-8859-1").cast("string")).otherwise(x)), "")


def any_in(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])
