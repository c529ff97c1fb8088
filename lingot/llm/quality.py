"""Quality of documents from overlapping heuristic labellers.

Each labeller looks at one measure of a text and says good, bad or nothing.  Their votes are counted
over all documents; expectation-maximisation estimates how often each is right without any labels; the
posteriors of a bounded sample train a linear scorer on hashed features of the text (its measures in
bins, its shapes of words, its commonest words), which then scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import weak_labels as wl
from .shared import kept, least_hashed
from .toxicity import held_out

#: Very common words of English, German, French and Spanish.
COMMON = frozenset(
    "the of and to in a is that it was for on with as be at by this from or an are der die das und in zu den von mit ist nicht ein eine auf für im auch "
    "le la les de des et un une en du que qui dans pour par sur au il el los las y que del se con una por su para es al lo".split()
)
#: Labellers: (measure, bad if above or below, good if on the other side of).  Fixed values of the heuristics.
LABELLERS = {
    "repeats": ("repeat", ">", 0.10, 0.04),
    "few_words": ("unique", "<", 0.30, 0.45),
    "same_word": ("top_word", ">", 0.25, 0.15),
    "symbols": ("symbol", ">", 0.04, 0.01),
    "letters": ("letter", "<", 0.78, 0.88),
    "shouting": ("upper", ">", 0.30, 0.12),
    "menus": ("bar", ">", 0.10, 0.01),
    "common_words": ("common", "<", 0.02, 0.06),
    "sentences": ("stop", "<", 0.004, 0.02),
    "exclaims": ("exclaim", ">", 0.15, 0.05),
    "word_length": ("length", ">", 7.0, 6.0),
    "line_copies": ("line_copy", ">", 0.40, 0.20),
}
#: Where EM starts: a defect shows in some bad texts and few good ones, its absence says little. [-, +] x [class 0, class 1].
FIRST_GUESS = np.array([[0.30, 0.02], [0.75, 0.95]])
SAMPLE_ROWS = 20_000
BUCKETS = 4_096
#: Classes of UTF-8 bytes: a letter is counted by its first byte.
_LOWER, _UPPER, _DIGIT, _SYMBOL, _BAR, _EXCLAIM, _OTHER, _SKIP = range(8)
_CLASS = np.full(256, _OTHER, dtype=np.int64)
_CLASS[[9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)]] = _SKIP
_CLASS[[*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in "*#$%&@^~<>\\{}=+"]] = _SYMBOL
_CLASS[ord("|")], _CLASS[ord("!")] = _BAR, _EXCLAIM


def measures(text: str | None) -> dict[str, float]:
    """Shares and means of a text; an empty one has none."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return {}
    count = Counter(words)
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=8).tolist()
    body = sum(kinds[:_SKIP])
    letters = kinds[_LOWER] + kinds[_UPPER]
    lines = [x for x in text.split("\n") if x.strip()]
    common = sum(count.get(w, 0) + count.get(w.title(), 0) for w in COMMON)
    return {
        "repeat": sum(map(eq, words, words[1:])) / n,
        "unique": len(count) / n if n >= 20 else 1.0,
        "top_word": max(count.values()) / n if n >= 20 else 0.0,
        "symbol": kinds[_SYMBOL] / max(1, body),
        "letter": letters / max(1, body),
        "upper": kinds[_UPPER] / max(1, letters),
        "bar": kinds[_BAR] / n,
        "common": common / n if n >= 12 else 0.1,
        "stop": (text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?"))) / n,
        "exclaim": kinds[_EXCLAIM] / n,
        "length": body / n,
        "line_copy": 1 - len(set(lines)) / max(1, len(lines)),
    }


def votes(m: dict[str, float]) -> list[int]:
    """One vote for each labeller: 1 good, -1 bad, 0 nothing."""
    if not m:
        return [0] * len(LABELLERS)
    out = []
    for name, side, bad, good in LABELLERS.values():
        x = m[name]
        out.append((-1 if x > bad else 1 if x < good else 0) if side == ">" else (-1 if x < bad else 1 if x > good else 0))
    return out


def features(text: str | None, m: dict[str, float]) -> np.ndarray:
    """Hashed features: measures in bins of a quarter of their threshold, shapes of words, and the ten commonest words."""
    names = [f"{name}:{min(12, int(4 * m[name] / bad))}" for name, _, bad, _ in LABELLERS.values()] if m else ["empty"]
    shapes: Counter[str] = Counter()
    for w, c in Counter((text or "").split()).items():
        shapes[("A" if w.isupper() else "Aa" if w[0].isupper() else "a") + ("" if w[-1].isalnum() else w[-1])] += c
    n = sum(shapes.values())
    names += [f"shape {s}:{min(5, int(10 * c / n))}" for s, c in shapes.items() if c >= max(2, 0.02 * n)]
    return np.array(sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names}), dtype=np.int64)


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted (1: keep) of every row of ``docs``.

    No labels are used.  The scorer is fitted on the ``sample_rows`` documents of least hash outside the held-out
    fifth; votes are counted over all.  Each text is read once; its votes and feature numbers are what is kept.
    A null or empty text gets no votes and the score of its lone feature; null and repeated doc_ids are scored
    like any other row; an empty table gives no rows; further columns are not read.
    """
    voters = len(LABELLERS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = [measures(t) for t in b["text"]]
            pattern = wl.encode(np.array([votes(x) for x in m], dtype=np.int8).reshape(-1, voters))
            yield b[["doc_id"]].assign(pattern=pattern, features=[features(t, x).astype(np.int16) for t, x in zip(b["text"], m, strict=True)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = kept(texts.mapInPandas(read, "doc_id long, pattern string, features array<smallint>"), "quality-read")
    patterns = kept(known.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "quality-patterns")
    model = wl.fit(patterns, voters, 0.8, np.tile(FIRST_GUESS, (voters, 1, 1)))
    fold = held_out(F.col("doc_id"))
    sample = least_hashed(known.where(~fold), sample_rows, "doc_id", "pattern").toPandas()
    rows = [np.asarray(r, dtype=np.int64) for r in sample["features"]]
    w = wl.train_linear(rows, BUCKETS, model.posterior(wl.decode(sample["pattern"], voters)), l2=1e-4) if len(rows) else np.zeros(BUCKETS + 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = wl.scores([np.asarray(r, dtype=np.int64) for r in b["features"]], w)
            yield b[["doc_id", "held_out"]].assign(score=s, predicted=(s >= 0.5).astype(np.int32))

    return known.withColumn("held_out", fold).select("doc_id", "held_out", "features").mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")
