"""Toxicity by weak supervision.

Voters are word lists by theme and language, patterns of address and emphasis, and word stems learned
from the labelled training rows.  Their votes are counted over all documents together with the training
labels, which are one more noisy voter; a generative label model estimates every voter's accuracy and
discounts correlated voters; a linear classifier on voters and word stems is trained on its posteriors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak_labels as wl
from .shared import about, kept, least_hashed

#: General words of insult by theme, in English, German, French and Spanish.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons stupid dumb imbecile fool dimwit dummkopf idiotin trottel dumm blöd schwachkopf imbécile crétin débile stupide idiote abruti estúpido estúpida idiota imbécil tonto necio",
    "worth": "worthless useless loser losers failure nobody wertlos nutzlos versager niemand nul inutile raté minable inútil fracasado perdedor",
    "disgust": "disgusting gross vile repulsive revolting filthy ekelhaft widerlich abscheulich dégoûtant répugnant infect asqueroso repugnante",
    "refuse": "trash garbage scum filth vermin rubbish abschaum müll dreck ungeziefer ordure déchet racaille vermine basura escoria alimaña",
    "scorn": "pathetic clown ridiculous joke laughable erbärmlich lächerlich witzfigur pathétique ridicule bouffon patético payaso ridículo",
    "hate": "hate despise detest hass verachte hasse haine déteste méprise odio desprecio detesto",
    "harm": "kill hang burn töte stirb crève mourir mata muere",
    "swear": "damn crap bastard bitch verdammt scheisse scheiße arschloch merde putain salaud connard mierda cabrón joder",
}
#: Patterns over the lower-case text, each a voter.
PATTERNS = {
    "address": r"\b(?:you are|you're|you all|du bist|ihr seid|tu es|vous êtes|eres un|eres una|sois unos)\b",
    "dismissal": r"\b(?:shut up|get lost|go away|halt die klappe|hau ab|ferme-la|va-t'en|cállate|lárgate)\b",
    "emphasis": r"!{2,}|\?!",
    "drawn": r"([^\W\d_])\1{3,}",
}
#: Bounds of what is fitted: labelled rows of the sample, stems that vote, stems that the classifier sees.
SAMPLE_ROWS = 20_000
STEM_VOTERS = 12
FEATURES = 600
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_REMEMBERED = 150_000


def stems(word: str) -> list[str]:
    """A word and its beginnings of 4 to 7 letters."""
    return ["=" + word, *(word[:n] for n in range(4, min(8, len(word) + 1)))]


def marks(stem: str, count: int) -> list[str]:
    """The features of a stem that occurs ``count`` times: that it does, and that it does again."""
    return [stem, stem + "@2"] if count > 1 else [stem]


class Reader:
    """Features and votes of texts: words are looked up once and remembered."""

    def __init__(self, stem_voters: list[str], features: list[str]):
        self.lexicon: dict[str, int] = {w: i for i, ws in enumerate(LEXICONS.values()) for w in ws.split()}
        self.patterns = [re.compile(p) for p in PATTERNS.values()]
        base = len(LEXICONS) + len(PATTERNS)
        self.numbers: dict[str, list[int]] = {}
        for i, s in enumerate([*stem_voters, *features]):
            self.numbers.setdefault(s, []).append(base + i)
        self.known = {s.removesuffix("@2") for s in self.numbers}
        self.voters = base + len(stem_voters)
        self.size = self.voters + len(features)
        self.seen: dict[str, tuple[str, ...]] = {}

    def read(self, text: str | None) -> np.ndarray:
        """Numbers of the voters that say + and of the features that are there, sorted."""
        low = (text or "").lower()
        if len(self.seen) > _REMEMBERED:
            self.seen.clear()
        found: set[int] = {len(LEXICONS) + i for i, p in enumerate(self.patterns) if p.search(low)}
        count: dict[str, int] = {}
        for word in _WORD.findall(low):
            hits = self.seen.get(word)
            if hits is None:
                hits = self.seen[word] = tuple(s for s in stems(word) if s in self.known or (s[0] == "=" and word in self.lexicon))
            for s in hits:
                count[s] = count.get(s, 0) + 1
        for s, n in count.items():
            if s[0] == "=" and s[1:] in self.lexicon:
                found.add(self.lexicon[s[1:]])
            for m in marks(s, n):
                found.update(self.numbers.get(m, ()))
        return np.array(sorted(found), dtype=np.int64)

    def votes(self, read: list[np.ndarray]) -> np.ndarray:
        v = np.zeros((len(read), self.voters), dtype=np.int8)
        for i, r in enumerate(read):
            v[i, r[r < self.voters]] = 1
        return v


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(stem, n, n_toxic) of each batch: in how many of its texts a stem occurs."""
    for b in batches:
        n: dict[str, int] = {}
        bad: dict[str, int] = {}
        for text, y in zip(b["text"], b["y"], strict=True):
            count: dict[str, int] = {}
            for w, c in Counter(_WORD.findall((text or "").lower())).items():
                for s in stems(w):
                    count[s] = count.get(s, 0) + c
            for s, c in count.items():
                for m in marks(s, c):
                    n[m] = n.get(m, 0) + 1
                    if y:
                        bad[m] = bad.get(m, 0) + 1
        # a stem that no toxic text of the batch holds still counts against it
        yield pd.DataFrame({"stem": list(n), "n": list(n.values()), "n_toxic": [bad.get(s, 0) for s in n]})


def _voting_stems(features: list[str], open_rows: list[set[int]]) -> list[str]:
    """The stems that vote: each adds toxic sample rows that the ones before it don't reach."""
    voting: list[str] = []
    while len(voting) < STEM_VOTERS:
        reach = np.zeros(len(features), dtype=np.int64)
        for h in open_rows:
            reach[list(h)] += 1
        if not len(reach) or reach.max() < 2:
            break
        best = int(reach.argmax())
        voting.append(features[best])
        open_rows = [h for h in open_rows if best not in h]
    return voting


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted (1: toxic) of every row of ``docs``.

    Learns labels only from documents whose crc32 of the doc_id as text is not divisible by five, at most
    ``sample_rows`` of them (the least by hash); the score is a function of the text alone.  All texts are read
    once, for their votes and features.  A null text is scored as an empty one; a document with several labels
    counts as toxic if one of them does; null labels and null doc_ids are ignored in training; rows that repeat
    a doc_id are scored each; without any labels the fixed voters alone decide; an empty table gives no rows;
    further columns are not read, but those in ``carried`` are returned beside.
    """
    gold = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y")).where(~held_out(F.col("id")))
    gold = kept(gold, "toxic-gold")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", *[F.col(c).alias(f"_{c}") for c in carried])
    beside = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    chosen = F.broadcast(least_hashed(gold, sample_rows, "id"))  # at most sample_rows pairs of numbers
    sample = kept(about(texts.join(chosen, "id"), sample_rows, "id", "text"), "toxic-sample")  # ids may repeat
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("y"), F.lit(0.1)).alias("p")).first()
    p = min(max(float(totals["p"]), 0.001), 0.5)
    counted = sample.mapInPandas(_stem_counts, "stem string, n long, n_toxic long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("bad"))
    support = max(3, totals["n"] // 2000)
    strength = (F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * F.lit(p * (1 - p)))
    strong = counted.where((F.col("bad") >= support) & (F.col("bad") >= 0.5 * F.col("n"))).withColumn("z", strength).orderBy(F.desc("z"), F.length("stem"), "stem").limit(FEATURES)
    features = [r["stem"] for r in strong.collect()]
    finder = Reader([], features)
    base = finder.voters
    covered = sample.where("y = 1").mapInPandas(lambda it: (pd.DataFrame({"hits": [(r[r >= base] - base).tolist() for r in map(finder.read, b["text"])]}) for b in it), "hits array<int>").toPandas() if features else pd.DataFrame({"hits": []})
    reader = Reader(_voting_stems(features, [set(h) for h in covered["hits"]]), features)
    voters = reader.voters + 1

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [reader.read(t) for t in b["text"]]
            yield b.drop(columns="text").assign(pattern=wl.encode(reader.votes(got)), read=[r.astype(np.int16) for r in got])

    known = kept(texts.mapInPandas(read, f"id long{beside}, pattern string, read array<smallint>"), "toxic-read")
    voted = known.select("id", "pattern").join(gold, "id", "left")
    said = F.when(F.col("y") == 1, "+").when(F.col("y") == 0, "-").otherwise("0")
    patterns = kept(voted.groupBy(F.concat("pattern", said).alias("pattern")).agg(F.count(F.lit(1)).alias("n")), "toxic-patterns")
    accuracy = np.full(voters, 0.8)
    accuracy[-1] = 0.95
    model = wl.fit(patterns, voters, p, wl.guess(accuracy))
    # the driver gets the sample's numbers of features, no texts
    got = least_hashed(known.join(chosen, "id"), sample_rows, "id", "pattern", "read").toPandas()
    rows, y = [np.asarray(r, dtype=np.int64) for r in got["read"]], got["y"].to_numpy()
    if len(rows):
        votes = np.column_stack([reader.votes(rows), np.where(y == 1, 1, -1)])
        w = wl.train_linear(rows, reader.size, model.posterior(votes))
    else:
        w = np.zeros(reader.size + 1)
        w[: len(LEXICONS)], w[-1] = 3.0, -2.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = wl.scores([np.asarray(r, dtype=np.int64) for r in b["read"]], w)
            yield b.drop(columns=["id", "read"]).assign(doc_id=b["id"], score=s, predicted=(s >= 0.5).astype(np.int32))

    told = known.drop("pattern").withColumn("held_out", held_out(F.col("id"))).mapInPandas(score, f"doc_id long, held_out boolean, score double, predicted int{beside}")
    return told.withColumnsRenamed({f"_{c}": c for c in carried})
