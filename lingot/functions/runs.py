"""Runs of text in one binary content, with their offsets: what a deep pass looks for beside whole-file text."""

from __future__ import annotations

import re

import numpy as np

from .codecs import legacy_runs_of
from .fields import _letters

_ASCII = re.compile(rb"[\x20-\x7e]{2,}")
_UTF8 = re.compile(rb"(?:[\x20-\x7e]|[\xc2-\xf4][\x80-\xbf]{1,3}){2,}")
#: Kinds of runs in the order in which they are looked for.
KINDS = ("deep-binary-ascii", "deep-binary-utf8", "deep-binary-gb18030", "deep-binary-big5", "deep-binary-utf16le", "deep-binary-utf16be")


def wide_runs(data: bytes, big_endian: bool) -> list[tuple[int, str]]:
    """Start and text of runs of two units of UTF-16 and more, from even offsets, that are printable ASCII, a tab or a letter."""
    units = np.frombuffer(data[: len(data) // 2 * 2], dtype=">u2" if big_endian else "<u2")
    good = ((units >= 32) & (units <= 126)) | (units == 9) | _letters()[units]
    edge = np.diff(good.astype(np.int8), prepend=0, append=0)
    codec = "utf-16-be" if big_endian else "utf-16-le"
    return [(2 * a, data[2 * a : 2 * b].decode(codec)) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b - a >= 2]


def deep_runs(data: bytes) -> list[tuple[int, int, str]]:
    """(place in KINDS, start, text) of every run."""
    out = [(0, m.start(), m.group().decode()) for m in _ASCII.finditer(data)]
    for m in _UTF8.finditer(data):
        try:
            text = m.group().decode()
        except UnicodeDecodeError:
            continue
        if not text.isascii():
            out.append((1, m.start(), text))
    for place, codec in ((2, "gb18030"), (3, "big5")):
        out += [(place, start, text) for start, text in legacy_runs_of(data, codec)]
    return out + [(4, *r) for r in wide_runs(data, False)] + [(5, *r) for r in wide_runs(data, True)]


def raw_runs(data: bytes) -> list[tuple[str, int, str]]:
    """(framing, start, text) of a content without framed fields: printable runs of four bytes with a letter, then Chinese runs."""
    out = [("raw-run", m.start(), m.group().decode()) for m in re.finditer(rb"[\x20-\x7e]{4,}", data) if re.search(rb"[A-Za-z]", m.group())]
    seen = {(start, text) for _, start, text in out}
    for codec in ("gb18030", "big5"):
        for start, text in legacy_runs_of(data, codec):
            if (start, text) not in seen:
                seen.add((start, text))
                out.append(("raw-cjk-run", start, text))
    return out
