"""Documents and vectors with every awkward case, and brute force over them."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rep long, key string, component string, score double, pattern string, h long, _key string, repeated string, digest long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def rows(n=60, seed=4):
    """Texts with exact and near copies, shared passages, repeats inside, empty, null and very long ones, ties and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["w" + "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(45)
    out = []
    for i in range(n):
        kind = i % 10
        t = text(rng.randint(1, 120))
        if kind == 1:
            t = text(10) + " " + passage + "\n" + text(12)
        if kind == 2 and i > 10:
            t = out[i - 10][1]  # an exact copy
        if kind == 3 and i > 10:
            w = words(out[i - 10][1])
            t = " ".join(w[:-1] + ["changed"]) if w else "x"
        if kind == 4:
            t = "same same " * 30
        if kind == 5 and i % 20 == 5:
            t = None
        if kind == 6 and i % 20 == 6:
            t = ""
        if kind == 7:
            t = text(25) + "\t\r\n  " + "  ".join(words(text(25)))
        if i == 8:
            t = text(9000)  # a very long one
        out.append((i * 3, t, "en" if i % 3 else None, "s%d" % (i % 4) if i % 7 else None, len(t or "")))
    out.append(out[1])  # a repeated row
    return out


def documents(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, 7, 8, "k", "c", 0.5, "+-", 9, "q", "r", 3) for r in data], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
