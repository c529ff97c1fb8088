"""Ids of whole texts from a word-level tokenizer file, the library's own, with each distinct word encoded once.

No word of the vocabulary holds white space, and no normal form or lower case reaches across it, so what stands
between white space (a chunk) is encoded apart.  A batch of texts is one array of characters; chunks of plain
characters are cut where the tokenizer's own pattern cuts them, the words are told apart by hash, and the new ones
go to the library, many in one text: where a word ends shows in its last id.  Any other chunk, and one that may hold
a special token's string, goes to the library as it stands.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np

from .wordarrays import mix, powers

#: Words and ids that a worker remembers; it starts afresh beyond that.
REMEMBERED = 800_000
REMEMBERED_IDS = 20_000_000
#: Words that go to the library in one text, and the longest word that is told by its hash.
JOINED, LONGEST = 50, 64
#: Characters beyond these blocks are never plain: Latin, Greek, Cyrillic, and general punctuation.
BLOCKS = ((0x20, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E))
_LETTER, _NUMBER, _MARK, _SPACE, _ODD = range(5)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every character; odd is what may change with its neighbours or in length."""
    kind, lower = np.full(0x110000, _ODD, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
    kind[[9, 10, 13, 32]] = _SPACE
    for first, last in BLOCKS:
        for point in range(first, last + 1):
            c, low = chr(point), chr(point).lower()
            if len(low) == 1 and all(unicodedata.is_normalized("NFC", x) and not unicodedata.combining(x) and unicodedata.category(x)[0] in "LNPS" for x in (c, low)):
                lower[point] = ord(low)
                kind[point] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(low)[0], _MARK)
    return kind, lower


class WordIds:
    """Ids of batches of texts; words are looked up once they were seen."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted hashes of words, and where their ids stand in the pool
        self.place = np.zeros((2, 0), dtype=np.int64)
        self.chunks: dict[str, tuple[int, int]] = {}
        self.pool = np.zeros(0, dtype=np.uint32)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.keys) + len(self.chunks) > REMEMBERED or len(self.pool) > REMEMBERED_IDS:
            self._forget()
        whole = " ".join([t or "" for t in texts]) + " "
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind_of, lower_of = _tables()
        kind, low = kind_of[raw], lower_of[raw]
        starts, ends, odd = self._words(raw, kind, low)
        at, many = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        plain = np.flatnonzero(~odd)
        at[plain], many[plain] = self._plain(low, starts[plain], ends[plain])
        loose = np.flatnonzero(odd)
        if len(loose):
            at[loose], many[loose] = self._odd([whole[a:b] for a, b in zip(starts[loose].tolist(), ends[loose].tolist(), strict=True)])
        end = np.cumsum(many)
        flat = self.pool[np.arange(end[-1] if len(end) else 0) + np.repeat(at - (end - many), many)].tobytes()
        stop = np.cumsum([len(t or "") + 1 for t in texts])
        cut = (4 * np.concatenate(([0], end))[np.searchsorted(starts, stop)]).tolist()
        return [flat[a:b] for a, b in zip([0, *cut], cut)]

    @staticmethod
    def _words(raw: np.ndarray, kind: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and which of them are chunks that the library gets as they stand."""
        inside = kind != _SPACE
        edge = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)))
        starts = np.flatnonzero(edge & inside)
        ends = np.append(starts[1:], len(raw))
        space = np.flatnonzero(~inside)  # the last character is one
        ends = np.minimum(ends, space[np.searchsorted(space, starts)])
        # 's 't 're 've 'm 'll 'd are words of their own, where the apostrophe stands alone
        quote = np.flatnonzero((low[starts[:-1]] == 39) & (ends[:-1] - starts[:-1] == 1) & (ends[:-1] == starts[1:]) & (kind[starts[1:]] == _LETTER))
        if len(quote):
            a, b = low[starts[quote + 1]], low[starts[quote + 1] + 1]
            two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
            two &= ends[quote + 1] - starts[quote + 1] >= 2
            take = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, np.where(two, 2, 0))
            ends[quote] += take
            starts[quote + 1] += take
            whole = starts < ends
            starts, ends = starts[whole], ends[whole]
        # chunks with an odd character, a special token's first characters or a very long word
        chunk_of = np.searchsorted(space, starts)
        bad = np.zeros(len(space) + 1, dtype=bool)
        bad[np.searchsorted(space, np.flatnonzero(kind == _ODD))] = True
        bad[np.searchsorted(space, np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))))] = True
        bad[chunk_of[ends - starts > LONGEST]] = True
        odd = bad[chunk_of]
        first = np.concatenate(([True], chunk_of[1:] != chunk_of[:-1])) if len(starts) else odd
        stays = ~odd | first
        starts, ends, odd, chunk_of = starts[stays], ends[stays], odd[stays], chunk_of[stays]
        return starts, np.where(odd, space[chunk_of], ends), odd

    def _plain(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of the ids of plain words."""
        if not len(starts):
            return starts, starts
        n = ends - starts
        first = np.cumsum(n) - n
        nth = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
        letters = low[nth + np.repeat(starts, n)].astype(np.uint64)
        key, where, back = np.unique(mix(np.add.reduceat(mix(letters * _BASE) * powers(_BASE, LONGEST)[nth], first) + n.astype(np.uint64)), return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, key)
        new = np.flatnonzero(np.append(self.keys, np.uint64(0))[known] != key if len(self.keys) else np.ones(len(key), dtype=bool))
        if len(new):
            text = low.tobytes().decode("utf-32-le", "surrogatepass")
            at = where[new]
            placed = self._learn([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            keys = np.concatenate((self.keys, key[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.place = keys[order], np.concatenate((self.place, placed), axis=1)[:, order]
            known = np.searchsorted(self.keys, key)
        at, many = self.place[:, known[back]]
        return at, many

    def _learn(self, words: list[str]) -> np.ndarray:
        """Adds the ids of words without white space to the pool; their places and numbers."""
        groups = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        got = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
        end = np.flatnonzero(self.ends[got]) + 1
        begin = np.concatenate(([0], end[:-1]))
        assert len(end) == len(words)
        placed = np.stack((len(self.pool) + begin, end - begin))
        self.pool = np.concatenate((self.pool, got))
        return placed

    def _odd(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = list({c for c in chunks if c not in self.chunks})
        if new:
            got = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            end = np.cumsum([len(x) for x in got]) + len(self.pool)
            self.chunks.update((c, (e - len(x), len(x))) for c, x, e in zip(new, got, end.tolist(), strict=True))
            self.pool = np.concatenate((self.pool, *got))
        at, many = zip(*map(self.chunks.__getitem__, chunks), strict=True)
        return np.array(at, dtype=np.int64), np.array(many, dtype=np.int64)
