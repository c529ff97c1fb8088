"""Slices of one content as text in the Chinese codecs, many at once.

A codec is an automaton that reads one unit (one, two or four bytes) at a time, so every position has one next position.  ASCII
bytes are units of their own, so only high bytes are places of a path, each with the next one behind its unit.  A slice
decodes if jumps from its start come to its end; jumps of 1, 2, 4, ... places, tables that are each made from the one before,
tell that in a few lookups.  What the text consists of is a difference of sums along the same path, made by doubling too.  A content is
looked at in windows, so memory doesn't grow with it.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Names of what a text was read as, by number; LEGACY are those of this module.
CODECS = ("utf-8", "gb18030", "gbk", "big5", "latin-1", "mixed-utf8-binary")
LEGACY = (1, 2, 3)
LATIN, MIXED = 4, 5
#: Starts of slices of a window, bytes of a slice at most, and tables of jumps: a unit of a high byte has two bytes at least.
WINDOW, LONGEST, STEPS = 1 << 20, 4096, 11
# Ranges of CJK letters, marks of wrongly decoded text, and weights of the measure of quality.
CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xAC00, 0xD7AF))
MARKS = "ÃÂæçåéðï¤¦¥\x81\x9c"
WEIGHTS = {"printable": 1.2, "letter": 0.6, "cjk": 0.9, "control": -1.7, "lost": -3.0, "mark": -0.9, "nul": -1.2}
#: Beyond this code no character is one of cp1252, so a text that holds one isn't repaired.
_LAST_CP1252 = 0x2122


@cache
def classes() -> np.ndarray:
    """For every code: printable, letter, CJK, control, U+FFFD, mark, NUL, beyond cp1252, and one for the character itself."""
    out = np.zeros((0x110001, 9), dtype=np.uint8)  # the last row stands for no character
    codes = np.arange(0x110000)
    out[:-1, 0] = np.fromiter(map(str.isprintable, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    out[[9, 10, 13], 0] = 1
    out[:-1, 1] = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    out[:-1, 2] = np.logical_or.reduce([(codes >= a) & (codes <= z) for a, z in CJK])
    out[:-1, 3] = (codes < 32) & ~np.isin(codes, (9, 10, 13))
    out[0xFFFD, 4] = 1
    out[[ord(c) for c in MARKS], 5] = 1
    out[0, 6] = 1
    out[_LAST_CP1252 + 1 : -1, 7] = 1
    out[:-1, 8] = 1
    return out


@cache
def pairs(codec: str) -> np.ndarray:
    """The character of every two bytes, -1 where they are none."""
    out = np.full(65536, -1, dtype=np.int32)
    for a in range(0x81, 0xFF):
        for b in range(0x40, 0xFF):
            try:
                text = bytes((a, b)).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(text) == 1:
                out[a * 256 + b] = ord(text)
    return out


@cache
def fours() -> np.ndarray:
    """The character of every four bytes of gb18030 by their number, -1 where they are none."""
    out = np.full(126 * 10 * 126 * 10, -1, dtype=np.int32)
    for n in range(39_420):
        code = bytes((0x81 + n // 12_600, 0x30 + n // 1_260 % 10, 0x81 + n // 10 % 126, 0x30 + n % 10))
        try:
            out[n] = ord(code.decode("gb18030"))
        except UnicodeDecodeError:
            continue
    out[189_000 : 189_000 + 0x100000] = np.arange(0x10000, 0x110000)
    return out


@cache
def kinds() -> np.ndarray:
    """The ``classes`` of every code as the bits of one number."""
    return (classes() @ (1 << np.arange(9, dtype=np.uint16))).astype(np.uint16)


_BITS = np.arange(512)[:, None] >> np.arange(9) & 1
#: Sums of a slice as fields of two numbers: number and first bit of each class.  13 bits hold LONGEST, and what is beyond cp1252 has two bytes.
_FIELDS = ((0, 0), (0, 13), (0, 26), (1, 0), (1, 13), (1, 26), (1, 39), (1, 52), (0, 39))
_PACKED = np.stack([sum((_BITS[:, k].astype(np.uint64) << np.uint64(at) for k, (n, at) in enumerate(_FIELDS) if n == i), np.zeros(512, dtype=np.uint64)) for i in (0, 1)], axis=1)


def _unpacked(sums: np.ndarray) -> np.ndarray:
    return np.stack([sums[:, n] >> np.uint64(at) & np.uint64(8191) for n, at in _FIELDS], axis=1).astype(np.int64)


def _units(a: np.ndarray, high: np.ndarray, codec: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the unit at each high byte ends, beyond the content if there is none, and its character (0x110000: none)."""
    n = len(a)
    b = np.concatenate((a, np.zeros(3, dtype=np.uint8)))
    first, second = b[high].astype(np.int32), b[high + 1].astype(np.int32)
    code, width = pairs(codec)[first * 256 + second], np.full(len(high), 2)
    if codec == "gb18030":
        at = np.flatnonzero((first <= 0xFE) & (first >= 0x81) & (second >= 0x30) & (second <= 0x39))
        third, fourth = b[high[at] + 2].astype(np.int32), b[high[at] + 3].astype(np.int32)
        quad = (third >= 0x81) & (third <= 0xFE) & (fourth >= 0x30) & (fourth <= 0x39)
        at, third, fourth = at[quad], third[quad], fourth[quad]
        four = fours()[(((first[at] - 0x81) * 10 + second[at] - 0x30) * 126 + third - 0x81) * 10 + fourth - 0x30]
        code[at], width[at] = four, 4
    end = high + width
    dead = (code < 0) | (end > n)
    end[dead], code[dead] = n + 1, 0x110000
    return end, code


class Places:
    """What the codecs share of a content: its high bytes, the first of them at or behind each place, and sums over its ASCII bytes."""

    def __init__(self, a: np.ndarray):
        self.a, self.high = a, np.flatnonzero(a >= 0x80)
        self.at = np.concatenate((self.high, (len(a),)))
        self.next = np.concatenate(([0], np.cumsum(a >= 0x80)))
        self.ascii = np.zeros((len(a) + 1, 2), dtype=np.uint64)
        np.cumsum(np.where((a < 0x80)[:, None], _PACKED[kinds()[a]], np.uint64(0)), axis=0, out=self.ascii[1:])

    def measured(self, start: np.ndarray, end: np.ndarray, codec: str) -> tuple[np.ndarray, np.ndarray]:
        """Which slices decode, and sums of ``classes`` over the characters of those."""
        n, h = len(self.a), len(self.high)
        after, code = _units(self.a, self.high, codec)
        behind = np.minimum(after, n)
        jump = np.append(np.where(after <= n, self.next[behind], h), h)
        jumps = [jump]
        for _ in range(min(STEPS, h.bit_length()) - 1):
            jumps.append(jumps[-1][jumps[-1]])
        at = self.next[start]
        plain = self.at[at] >= end
        for step in reversed(jumps):
            ahead = step[at]
            at = np.where(self.at[ahead] < end, ahead, at)
        good = plain | (np.append(after, n + 1)[at] <= end)
        if not good.any():
            return good, np.zeros((0, 9), dtype=np.int64)
        total = np.zeros((h + 1, 2), dtype=np.uint64)
        # sums wrap round, and their differences are right all the same
        total[:-1] = _PACKED[kinds()[code]] + self.ascii[self.at[jump[:-1]]] - self.ascii[behind]
        total[:-1][after > n] = 0
        level = 0
        while (jump < h).any():
            total += total[jump]
            level += 1
            jump = jumps[level] if level < len(jumps) else jump[jump]
        rest = lambda x: total[self.next[x]] + self.ascii[self.at[self.next[x]]] - self.ascii[x]
        return good, _unpacked(rest(start[good]) - rest(end[good]))


def quality(text: str) -> float:
    return float(_quality(sums_of(text)[None, :].astype(np.float64))[0]) if text else -10.0


def sums_of(text: str) -> np.ndarray:
    """Sums of ``classes`` over the characters of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(kinds()[codes], minlength=512) @ _BITS


def _quality(sums: np.ndarray) -> np.ndarray:
    return (sums[:, :7] / sums[:, 8:]) @ np.array(list(WEIGHTS.values()))


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 or cp1252, if that is much better."""
    if not any(m in text for m in MARKS):
        return text
    best, score = text, quality(text)
    for codec in ("latin-1", "cp1252"):
        try:
            other = text.encode(codec).decode()
        except UnicodeError:
            continue
        if quality(other) > score + 0.08:
            best, score = other, quality(other)
    return best


def best_codec(data: bytes) -> int:
    """The codec (by number in CODECS) as which one slice is read best, LATIN if no Chinese one decodes it; -1 if the text has no letter then."""
    texts = []
    for n in LEGACY:
        try:
            texts.append((n, repaired(data.decode(CODECS[n]))))
        except UnicodeDecodeError:
            continue
    if not texts:
        return LATIN if any(c.isalpha() for c in data.decode("latin-1")) else -1
    n, text = max(texts, key=lambda t: (round(quality(t[1]), 9), -t[0]))
    return n if any(c.isalpha() for c in text) else -1


def best_codecs(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``best_codec`` of slices of LONGEST bytes at most."""
    out = np.full(len(start), -1, dtype=np.int64)
    letters = np.concatenate(([0], np.cumsum(classes()[a, 1])))
    for low in range(0, len(a), WINDOW):
        here = np.flatnonzero((start >= low) & (start < low + WINDOW))
        if not len(here):
            continue
        part, s, e = a[low : low + WINDOW + LONGEST], start[here] - low, end[here] - low
        best, score, has = np.full(len(here), LATIN), np.full(len(here), -np.inf), letters[end[here]] > letters[start[here]]
        odd, places = np.zeros(len(here), dtype=bool), Places(part)
        for n in LEGACY:
            good, sums = places.measured(s, e, CODECS[n])
            at = np.flatnonzero(good)
            told = np.round(_quality(sums.astype(np.float64)), 9) if len(at) else np.zeros(0)
            better = at[told > score[at]]
            score[better], best[better], has[better] = told[told > score[at]], n, sums[told > score[at], 1] > 0
            odd[at] |= (sums[:, 5] > 0) & (sums[:, 7] == 0)  # a text that may be wrongly decoded is looked at by itself
        out[here] = np.where(has, best, -1)
        for i in np.flatnonzero(odd).tolist():
            out[here[i]] = best_codec(part[s[i] : e[i]].tobytes())
    return out


def islands(data: bytes) -> str:
    """Bytes as text: valid multi-byte UTF-8 sequences decoded, every other byte as the Latin-1 character."""
    out, i = [], 0
    while i < len(data):
        width = 4 if data[i] >= 0xF0 else 3 if data[i] >= 0xE0 else 2
        try:
            out.append(data[i : i + width].decode() if data[i] >= 0xC2 else chr(data[i]))
            i += width if data[i] >= 0xC2 else 1
        except UnicodeDecodeError:
            out.append(chr(data[i]))
            i += 1
    return "".join(out)


def read(data: bytes, codec: int) -> str:
    """The text of a slice whose codec is told."""
    if codec == MIXED:
        return islands(data)
    text = data.decode(CODECS[codec])
    return repaired(text) if codec in LEGACY else text
