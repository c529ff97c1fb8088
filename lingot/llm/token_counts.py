"""Exact token counts of a byte-fallback BPE vocabulary by rank-synchronous merging of ragged arrays.

A text is cut where no piece of the vocabulary can reach across: before a run of word-start marks and
around characters that no piece holds.  The distinct pre-tokens of a batch lie end to end in one numpy
array of symbols; in each round every pre-token applies its lowest-rank pair, at all places at once
where that provably equals merging them one by one, else at the first.  What survives is counted:
one token for a symbol of the vocabulary, one for each UTF-8 byte of any other character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_STOP = re.compile(f"(?<=[a-z])[.,](?=[{MARK}\\n]|\\Z)")
_NONE = np.int32(2**31 - 1)
#: Counts of pre-tokens that a worker remembers; it starts afresh beyond that.
REMEMBERED = 600_000


class PieceVocabulary:
    """Ranks of pairs of symbols, read from a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.symbol = {p: i for i, p in enumerate(score)}
        self.known = len(self.symbol)
        for p in score:
            for c in p:
                self.symbol.setdefault(c, len(self.symbol))
        self.size = len(self.symbol)
        pairs = [(self.symbol[p[:k]] * self.size + self.symbol[p[k:]], rank_of[s], self.symbol[p]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        pairs.sort()
        self.pair_keys = np.array([x[0] for x in pairs], dtype=np.int64)
        self.pair_ranks = np.array([x[1] for x in pairs] + [_NONE], dtype=np.int32)
        self.pair_merged = np.array([x[2] for x in pairs] + [-1], dtype=np.int32)
        self.marks_lead = not any(MARK in p.lstrip(MARK) for p in score)
        self.newline_alone = "\n" not in self.symbol
        #: . and , that stand after a letter and before a mark or line break are then tokens of their own
        self.stops_alone = all(c in self.symbol for c in ".,") and not any(re.search("[a-z][.,]", p) for p in score)
        self.by_point = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.by_point[ord(c)] = i

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the largest rank where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        at = np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), at, len(self.pair_keys))
        return self.pair_ranks[at], self.pair_merged[at]

    def count(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        total = np.zeros(len(words), dtype=np.int64)
        text = "".join(words)
        if not text:
            return total
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbol = self.by_point[points]
        utf8 = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
        # a character outside the vocabulary counts its bytes; one that only longer pieces hold may be merged later
        odd = symbol >= self.known
        byte_count = dict(zip(symbol[odd].tolist(), utf8[odd].tolist(), strict=True))
        lone = symbol < 0
        np.add.at(total, owner[lone], utf8[lone])
        # a lone character also separates what stands left and right of it
        stretch = np.cumsum(lone)
        ids, owner, stretch = symbol[~lone], owner[~lone], stretch[~lone]
        sequence = np.cumsum(np.concatenate(([False], (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1])))) if len(ids) else np.zeros(0, dtype=np.int64)
        word_of = owner[np.concatenate(([True], sequence[1:] != sequence[:-1]))] if len(ids) else owner
        for seq, left in self._merged(ids, sequence):
            n = np.ones(len(left), dtype=np.int64)
            for s, k in byte_count.items():
                n[left == s] = k
            total += np.bincount(word_of[seq], weights=n, minlength=len(words)).astype(np.int64)
        return total

    def _merged(self, ids: np.ndarray, seq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (sequence, surviving symbol) once no pair of the sequence is left."""
        rank, merged = self._adjacent(ids, seq)
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            best = np.repeat(least, lengths)
            over = best == _NONE
            if over.any():
                yield seq[over], ids[over]
                go = ~over
                ids, seq, rank, merged, best = ids[go], seq[go], rank[go], merged[go], best[go]
                if not len(ids):
                    return
            at = np.flatnonzero(rank == best)
            # of pairs that overlap in a run (a a a), every other one from the left
            run = np.concatenate(([True], np.diff(at) != 1))
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            first = np.concatenate(([True], seq[at[1:]] != seq[at[:-1]]))
            if not first.all():
                at = at[first | ~self._interferes(ids, seq, merged, best, at)]
            ids[at] = merged[at]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            ids, seq, rank, merged = ids[stay], seq[stay], rank[stay], merged[stay]
            new = place[at]
            self._refresh(ids, seq, rank, merged, np.concatenate((new, new[new > 0] - 1)))

    def _interferes(self, ids: np.ndarray, seq: np.ndarray, merged: np.ndarray, best: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each place: whether merging all places of its sequence could differ from one by one."""
        n = len(ids)
        bad = np.zeros(len(at), dtype=bool)
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
        has_before, has_after = (at > 0) & (seq[before] == seq[at]), (at + 2 < n) & (seq[after] == seq[at])
        mine = merged[at]
        bad |= has_before & (self.pairs(ids[before], mine)[0] <= best[at])
        bad |= has_after & (self.pairs(mine, ids[after])[0] <= best[at])
        nxt = np.zeros(len(at), dtype=bool)
        nxt[:-1] = (at[1:] == at[:-1] + 2) & (seq[at[1:]] == seq[at[:-1]])
        bad[:-1] |= nxt[:-1] & (self.pairs(mine[:-1], mine[1:])[0] <= best[at[:-1]])
        worst = np.zeros(int(seq[-1]) + 1, dtype=bool)
        worst[seq[at[bad]]] = True
        return worst[seq[at]]

    def _adjacent(self, ids: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(ids), _NONE, dtype=np.int32), np.full(len(ids), -1, dtype=np.int32)
        if len(ids) > 1:
            self._refresh(ids, seq, rank, merged, np.arange(len(ids)))
        return rank, merged

    def _refresh(self, ids: np.ndarray, seq: np.ndarray, rank: np.ndarray, merged: np.ndarray, at: np.ndarray) -> None:
        last = at == len(ids) - 1
        rank[at[last]], merged[at[last]] = _NONE, -1
        at = at[~last]
        r, m = self.pairs(ids[at], ids[at + 1])
        apart = seq[at] != seq[at + 1]
        rank[at], merged[at] = np.where(apart, _NONE, r), m


@lru_cache(maxsize=2)
def _vocabulary(model_file: str) -> PieceVocabulary:
    return PieceVocabulary(model_file)


def _pretokens(text: str, v: PieceVocabulary) -> tuple[list[str], int]:
    """The pre-tokens of a text, and the tokens that are already sure (line breaks)."""
    text = MARK + text.replace(" ", MARK)
    if not v.marks_lead:
        return [text], 0
    sure = 0
    if v.stops_alone:
        text, sure = _STOP.subn("", text)
    lines = text.split("\n") if v.newline_alone else [text]
    if MARK + MARK in text or text.endswith(MARK):
        found = [w for line in lines for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line)]
        return [w if w[0] == MARK else "\n" + w for w in found], sure + len(lines) - 1
    out: list[str] = []
    for line in lines:
        head, *rest = line.split(MARK)
        if head:
            out.append("\n" + head)  # not after a mark
        out += rest
    return out, sure + len(lines) - 1


class TokenCounter:
    """Counts tokens of texts; pre-tokens that were seen are looked up, new ones merged together."""

    def __init__(self, model_file: str):
        self.vocabulary = _vocabulary(model_file)
        self.seen: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        look, out, missing = self.seen.get, [], []
        for t in texts:
            words, n = _pretokens(t, self.vocabulary) if t else ([], 0)
            found = list(map(look, words))
            rest = []
            if None in found:
                rest = [w for w, c in zip(words, found, strict=True) if c is None]
                found = [c for c in found if c is not None]
            out.append(n + sum(found))
            missing.append(rest)
        new = list({w for ws in missing for w in ws})
        if new:
            # a key that starts with a line break or a mark stands for itself, any other follows a mark
            plain = [w[1:] if w[:1] == "\n" else w if w[:1] == MARK or not self.vocabulary.marks_lead else MARK + w for w in new]
            count = dict(zip(new, self.vocabulary.count(plain).tolist(), strict=True))
            self.seen.update(count)
            out = [n + sum(map(count.__getitem__, ws)) for n, ws in zip(out, missing, strict=True)]
        return out


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``, as sentencepiece gives them for the whole text.

    No begin, end or added tokens; strings such as ``<s>`` are plain text.  A null text counts as empty (0
    bytes, 0 tokens); null and repeated doc_ids are rows like any other; an empty table gives no rows;
    further columns are not read.
    """
    from .wordarrays import text_batches

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(model_file)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [c for part in text_batches(texts) for c in counter.counts(texts[part])]
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            over = [c > limit for c in n]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(over, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
