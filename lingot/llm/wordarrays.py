"""Words of a batch of texts as flat numpy arrays, with hashes of words and of runs of words.

A word is a run of bytes other than space and U+0009..U+000D, so words never depend on locale or
Unicode version.  All hashes are 64-bit and depend only on the bytes of the words, never on the
batch, so that they agree between tasks and runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_SECOND_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are turned into arrays at once; a longer text stands alone.
BATCH_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Places of a word's bytes that have numbers of their own; longer words are hashed one by one.
PLACES = 64
#: A random number for every byte at every place, and a second one.
_NUMBERS = tuple(mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _BYTE_BASE + base) for base in (_WORD_BASE, _SECOND_BASE))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base², ... modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


class Words:
    """The words of several texts, one after the other.

    ``hashes[i]`` is the hash of word i, ``starts[i]`` and ``ends[i]`` its bytes in ``data``;
    the words of text t are ``first[t]:first[t + 1]``.
    """

    def __init__(self, texts: list[str | None]):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join(encoded) + b" "
        buf = np.frombuffer(self.data, dtype=np.uint8)
        space = _IS_SPACE[buf]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.array([len(e) + 1 for e in encoded], dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, begins[: len(texts) + 1])
        self.first[-1] = len(self.starts)
        self.hashes = self._word_hashes(0)
        self._sums: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.starts)

    def _word_hashes(self, nth: int) -> np.ndarray:
        """Sums of random numbers for each byte at its place, so that no two words are alike by their form; nth: which of two independent ones."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        buf = np.frombuffer(self.data, dtype=np.uint8)
        lengths = self.ends - self.starts
        place = np.arange(len(buf), dtype=np.int32)  # of each byte within its word
        lead = self.starts[0]
        place[lead:] -= np.repeat(self.starts.astype(np.int32), np.diff(np.append(self.starts, len(buf))))
        terms = _NUMBERS[nth][np.minimum(place, PLACES - 1) * 256 + buf]
        terms[_IS_SPACE[buf]] = 0
        out = mix(np.add.reduceat(terms, self.starts) + lengths.astype(np.uint64))
        for i in np.flatnonzero(lengths > PLACES):
            digest = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8, salt=bytes([nth])).digest()
            out[i] = np.uint64(int.from_bytes(digest, "little"))
        return out

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k consecutive words of one text, and the first word of each."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        owner = self.owner()
        at = np.flatnonzero(owner[: n] == owner[k - 1 :])
        return mix(self.span_sums(at, at + k)), at

    def span_sums(self, begin: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
        """Position-free polynomial sums of the words begin..end-1 (unmixed); a second sum, of other hashes, on request."""
        if second not in self._sums:
            n = len(self.hashes)
            base = _SECOND_BASE if second else _WORD_BASE
            h = self._word_hashes(1) if second else self.hashes
            self._sums[second] = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(base, n), dtype=np.uint64))), powers(_inverse(base), n + 1)
        prefix, back = self._sums[second]
        return (prefix[end] - prefix[begin]) * back[begin]


def column_batches(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[slice, list[str | None]]]:
    """Slices of consecutive rows of a column of texts, of about ``most`` bytes, with their texts: never the whole column as Python strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and size + n > most:
            yield slice(begin, i), column.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield slice(begin, len(sizes)), column.slice(begin).to_pylist()


def text_batches(texts: list[str | None], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of consecutive texts of about ``most`` bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def byte_slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows of a binary column, of about ``most`` bytes; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1)
        yield slice(begin, end)
        begin = end


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where in them each value begins (one place more: the end)."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, ends - ends[0]


def words_of(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The row of each word of a binary column without nulls, and the words themselves, in order, of about ``most`` bytes of whole rows at a time."""
    for part in byte_slices(column, most):
        buf, begins = joined_bytes(column.slice(part.start, part.stop - part.start))
        if not len(buf):
            continue
        inside = ~_IS_SPACE[buf]
        opens, closes = inside.copy(), inside.copy()  # where a word begins and ends: at white space, and at the edge of a value
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        new = begins[:-1][np.diff(begins) > 0]
        opens[new] = inside[new]
        closes[new[1:] - 1] = inside[new[1:] - 1]
        starts = np.flatnonzero(opens)
        offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(closes) + 1 - starts))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
        yield np.searchsorted(begins, starts, side="right") - 1 + part.start, words
