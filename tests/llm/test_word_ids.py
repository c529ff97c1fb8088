"""Ids of words against the library's of the whole text, over characters that change with their neighbours."""

from __future__ import annotations

import random

import numpy as np

from lingot.llm import word_ids
from lingot.llm.queries import tokenizer_path

MARKS = [chr(p) for p in range(0x300, 0x345)]
LETTERS = [[chr(p) for p in range(a, b)] for a, b in ((0x41, 0x250), (0x370, 0x400), (0x400, 0x530), (0x1E00, 0x2000), (0x20, 0x7F))]
OTHERS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "'s", "'RE", "'ll", "''s", "1'd", "n't", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "İ", "ẞ", "Σας", "ﬁ", "Ω", "각", "ᄀ", "字", "あ", "😀", "…", "“", "×", "x" * 70]


def _same(texts):
    found = word_ids.WordIds(tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):  # seen words are looked up the second time
        for text, got in zip(texts, found.ids(texts), strict=True):
            want = found.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert got == np.array(want, dtype="<u4").tobytes(), ascii(text)


def test_letters_with_marks():
    _same([c + m for c in (*LETTERS[0], *LETTERS[1][::2], *LETTERS[2][::3]) for m in MARKS[::2]])
    _same([c + m for c in "TtWwYyJjHhAaΙιΥυИи" for m in MARKS] + ["T̈́", "ẗ", None, ""])


def test_mixed_texts():
    rng = random.Random(8)
    texts = []
    for _ in range(8000):
        pools = [rng.choice(LETTERS), rng.choice(LETTERS), MARKS, OTHERS]
        texts.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 12))))
    _same(texts)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(word_ids, "REMEMBERED", 5)
    found = word_ids.WordIds(tokenizer_path("word_bpe_49k.json"))
    texts = [f"word{i} other{i} 字{i}" for i in range(30)]
    got = [found.ids([t])[0] for t in texts]
    assert got == word_ids.WordIds(tokenizer_path("word_bpe_49k.json")).ids(texts)
