"""Framed text fields in one binary content: numpy kernels that read every offset at once and need memory in proportion to the content."""

from __future__ import annotations

from functools import cache

import numpy as np

from . import legacy

#: Framings by name in order, and of each: bytes of its length, longest text, confidence when safe and when not.
FRAMINGS = ("null", "u16be", "u16le", "u8")
KINDS = {"u16be": (2, 4096, 96, 72), "u16le": (2, 4096, 94, 72), "u8": (1, 240, 94, 70)}
#: Confidence of null-terminated texts when safe and when not.
NULL = (82, 68)
LEAST = 3
#: A player's text has one of these or a letter of the Chinese blocks below, and at most so many characters.
MARKS = b" .,!?;:'\"-"
CHINESE = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
LONGEST = 800


@cache
def _letters() -> np.ndarray:
    return legacy.classes()[:-1, 1] > 0


def sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(x, dtype=np.int64)))


class Bytes:
    """Prefix sums over a content, so that any slice of it is judged as UTF-8 text in a few lookups.

    ``halves``: surrogates in three bytes are characters too, as in the modified form.
    """

    def __init__(self, content: bytes, halves: bool = False):
        a = self.a = np.frombuffer(content, dtype=np.uint8)
        n = self.n = len(a)
        code, begins, self.inner = a.astype(np.int32), a < 0x80, np.zeros(n + 1, dtype=bool)
        b = np.concatenate((a, np.zeros(3, dtype=np.uint8))).astype(np.int32)
        lead = np.flatnonzero(a >= 0xC2)
        tails = [(b[lead + i] & 0xC0) == 0x80 for i in (1, 2, 3)]
        low = [b[lead + i] & 63 for i in (1, 2, 3)]
        first = b[lead]
        forms = (
            (1, (first <= 0xDF) & tails[0], (first & 31) << 6 | low[0], 0x80, 0x7FF),
            (2, (first >= 0xE0) & (first <= 0xEF) & tails[0] & tails[1], (first & 15) << 12 | low[0] << 6 | low[1], 0x800, 0xFFFF),
            (3, (first >= 0xF0) & (first <= 0xF4) & tails[0] & tails[1] & tails[2], (first & 7) << 18 | low[0] << 12 | low[1] << 6 | low[2], 0x10000, 0x10FFFF),
        )
        for more, fits, value, least, most in forms:
            fits = fits & (value >= least) & (value <= most) & (halves | (value < 0xD800) | (value > 0xDFFF))
            at = lead[fits]
            begins[at], code[at] = True, value[fits]
            for i in range(1, more + 1):
                self.inner[at + i] = True
        self.code, self.begins = code, begins
        self.bad = sums(~begins & ~self.inner[:n])
        self.chars = sums(begins)
        self.letters = sums(begins & _letters()[code])
        self.texty = sums(((a >= 32) & (a < 127)) | (a == 9) | (a >= 128))
        self.controls = sums((a < 32) & (a != 9) & (a != 10) & (a != 13))

    def texts(self, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """As what each slice is read (by number in legacy.CODECS, -1: no text), and which, with at least so many letters, are safe to rewrite.

        A slice is text if its bytes are mostly printable or high, and it has a letter: as UTF-8, else as the best of the Chinese codecs, or as
        Latin-1 where none of these decodes it.  Only UTF-8 is safe.
        """
        letters = self.letters[end] - self.letters[start]
        whole = (self.bad[end] == self.bad[start]) & ~self.inner[start] & ~self.inner[end]
        looks = (self.texty[end] - self.texty[start]) / np.maximum(end - start, 1) >= 0.85
        codec = np.where(looks & whole & (letters > 0), 0, -1)
        rest = np.flatnonzero(looks & (codec < 0))
        if len(rest):
            codec[rest] = self.other(start[rest], end[rest])
        return codec, (codec == 0) & (letters >= least) & (self.controls[end] == self.controls[start])

    def other(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The codec of slices that are no UTF-8 with a letter; one before a zero byte may be of any length, and of islands of UTF-8."""
        return legacy.best_codecs(self.a, start, end)


class Chunks(Bytes):
    """A content whose slices are the stretches between zero bytes, which don't overlap."""

    def __init__(self) -> None:  # its sums are another view's
        pass

    @classmethod
    def of(cls, view: Bytes) -> Chunks:
        chunks = cls()
        chunks.__dict__ = view.__dict__
        return chunks

    def other(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        cjk = sums(self.begins & (legacy.classes()[self.code, 2] > 0) & (self.a >= 0x80))
        mixed = cjk[end] - cjk[start] >= 2
        return np.array([legacy.MIXED if m else legacy.best_codec(self.a[s:e].tobytes()) for m, s, e in zip(mixed.tolist(), start.tolist(), end.tolist(), strict=True)], dtype=np.int64)


def candidates(content: bytes) -> dict[str, np.ndarray]:
    """start, length (both with the frame), framing (its place in FRAMINGS), head, confidence, safe, codec (in legacy.CODECS) of every field at every offset."""
    view, found = Bytes(content), []
    b = view.a.astype(np.int32)
    for name, (head, most, good, poor) in KINDS.items():
        if view.n <= head:
            continue
        n = b if head == 1 else b[:-1] * 256 + b[1:] if name == "u16be" else b[1:] * 256 + b[:-1]
        at = np.flatnonzero((n >= LEAST) & (n <= most) & (np.arange(len(n)) + head + n <= view.n))
        found.append((at, n[at], *(np.full(len(at), x) for x in (FRAMINGS.index(name), head, good, poor))))
    parts = []
    if found:  # all framings with a length are looked at together
        at, n, framing, head, good, poor = (np.concatenate(x) for x in zip(*found, strict=True))
        parts.append(_told(view, framing, at, at + head, at + head + n, at + head + n, good, poor))
    end = np.flatnonzero(view.a == 0)
    at = np.concatenate(([0], end + 1))[:-1]
    at, end = at[end - at >= LEAST], end[end - at >= LEAST]
    framing, good, poor = (np.full(len(at), x) for x in (FRAMINGS.index("null"), *NULL))
    parts.append(_told(Chunks.of(view), framing, at, at, end, end + 1, good, poor, letters=1))
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _told(view: Bytes, framing: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, stop: np.ndarray, good: np.ndarray, poor: np.ndarray, letters: int = 2) -> dict[str, np.ndarray]:
    codec, safe = view.texts(start, end, letters)
    ok = codec >= 0
    at, start, stop, safe = at[ok], start[ok], stop[ok], safe[ok]
    return {"start": at, "length": stop - at, "framing": framing[ok], "head": start - at, "confidence": np.where(safe, good[ok], poor[ok]), "safe": safe, "codec": codec[ok]}


def text_of(content: bytes, found: dict[str, np.ndarray], i: int) -> str:
    """The text of a field that ``candidates`` found."""
    end = int(found["start"][i] + found["length"][i]) - (found["framing"][i] == FRAMINGS.index("null"))
    return legacy.read(content[int(found["start"][i] + found["head"][i]) : end], int(found["codec"][i]))


def strongest(found: dict[str, np.ndarray], size: int) -> np.ndarray:
    """Places of the candidates that fit together, taken one by one: safe first, then confidence, then short and early texts (without their frame)."""
    text = found["length"] - found["head"] - (found["framing"] == FRAMINGS.index("null"))
    order = np.lexsort((found["framing"], found["start"] + found["head"], text, -found["confidence"], ~found["safe"]))
    start = found["start"][order]
    taken, won = bytearray(size), []
    for i, (s, e) in enumerate(zip(start.tolist(), (start + found["length"][order]).tolist(), strict=True)):
        if not taken[s] and not taken[e - 1] and taken.find(1, s, e) < 0:
            taken[s:e] = b"\x01" * (e - s)
            won.append(i)
    return order[won]


def player_texts(*contents: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content, start and end of the frames (16-bit big-endian length and modified UTF-8) of texts that a player may read, the earliest first and none inside another.

    Contents are looked at together, a zero byte between them, which is part of no character and no frame.
    """
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    view = Bytes(b"\x00".join(contents), halves=True)
    n = view.n
    if n < 3:
        return (np.zeros(0, dtype=np.int64),) * 3
    b = view.a.astype(np.int64)
    long = b[:-1] * 256 + b[1:]
    ends = np.repeat(begins + sizes, sizes + 1)[: n - 1]  # where the content of each place ends
    at = np.flatnonzero((long >= 1) & (np.arange(n - 1) + 2 + long <= ends))
    s, e = at + 2, at + 2 + long[at]
    code = np.where(view.begins, view.code, 0)
    # a high and a low half, three bytes each, are one character if both are in the slice
    high = (code[:-3] >= 0xD800) & (code[:-3] <= 0xDBFF) & (code[3:] >= 0xDC00) & (code[3:] <= 0xDFFF)
    joined = np.where(high, 0x10000 + ((code[:-3] & 0x3FF) << 10) + (code[3:] & 0x3FF), 0)
    pairs, pair_letters = sums(high), sums(high & _letters()[joined])
    last = np.clip(np.maximum(e - 5, s), 0, n - 3)
    first = np.minimum(s, last)
    within = lambda c: c[e] - c[s]
    letters = within(view.letters) + pair_letters[last] - pair_letters[first]
    chars = within(view.chars) - (pairs[last] - pairs[first])
    chinese = within(sums(np.logical_or.reduce([(code >= a) & (code <= z) for a, z in CHINESE])))
    marks = within(sums(np.isin(view.a, np.frombuffer(MARKS, dtype=np.uint8))))
    whole = (within(view.bad) == 0) & ~view.inner[s] & ~view.inner[e] & (within(view.controls) == 0) & (chars <= LONGEST)
    ok = whole & ((chinese > 0) | ((letters >= 2) & (marks > 0)))
    at, e = at[ok], e[ok]
    behind = np.searchsorted(at, e).tolist()
    won, i = [], 0
    while i < len(behind):
        won.append(i)
        i = behind[i]
    which = np.searchsorted(begins, at[won], side="right") - 1
    return which, at[won] - begins[which], e[won] - begins[which]
