"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from lingot.llm import bag_minhash, kd_sharding, mixing, packing, quality, substring_dedup, token_counts, toxicity
from lingot.llm.queries import tokenizer_path

from . import fixtures as fx


def test_token_counts_are_the_librarys(spark):
    import sentencepiece

    data = fx.rows()
    data += [(900 + i, t, None, None, 0) for i, t in enumerate(["<s> a  b</s>", " ", "\n", "a" * 3000, "ab" * 900 + " x", "▁ ▁▁x", "\U0001f600é\x00z", "tab\tand\r\nbreak", "Don't. stop,now. e.g., 12.5"])]
    data.append((None, "no id", None, None, 0))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = token_counts.token_counts(fx.documents(spark, data), tokenizer_path("piece_bpe_32k.model"), limit=100).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 100) for r in data)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(fx.empty(spark), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    data = [*fx.rows(), (901, "A<|endoftext|>b <|ENDOFTEXT|>", None, None, 0), (902, "é Σας it's. 1,2", None, None, 0), (None, "no id", None, None, 0)]
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    capacity = 256
    got = packing.pack(fx.documents(spark, data), tokenizer_path("word_bpe_49k.json"), capacity=capacity).collect()
    want = []
    for r in data:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want.append((str(r[0]), k, at, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r["offset"], r.length))
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity
    assert len(sequences) <= -(-sum(x[3] for x in want) // capacity) + 2
    assert packing.pack(fx.empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_plan_uses_the_histogram_exactly():
    histogram = {4096: 3, 4000: 5, 96: 2, 2048: 7, 1000: 40, 3: 1000, 1: 1}
    left = dict(histogram)
    for pattern, times in packing.plan_sequences(histogram, 4096):
        assert times > 0 and sum(n * m for n, m in pattern.items()) <= 4096
        for n, m in pattern.items():
            left[n] -= m * times
    assert not any(left.values())


def test_shards_are_near_equal(spark):
    data = [*fx.rows(400), (None, "no id", None, None, 0)]
    got = kd_sharding.kd_shards(fx.documents(spark, data), n_shards=6).collect()
    assert len(got) == len(data)
    texts = defaultdict(list)
    for r in data:
        texts[r[0]].append((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())))
    total, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) in texts[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / 6
    largest = max(r.size for r in got)
    assert set(total) <= set(range(6)) and all(abs(x - mean) <= largest + 0.05 * mean for x in total.values())


def test_one_hot_value_is_cut_like_any_other(spark):
    data = [(i, "the same text", "en", "s", 13) for i in range(3000)]
    got = kd_sharding.kd_shards(fx.documents(spark, data), n_shards=5).groupBy("shard").count().collect()
    assert len(got) == 5 and all(abs(r["count"] - 600) < 40 for r in got)


def test_sharding_an_empty_table(spark):
    assert kd_sharding.kd_shards(fx.empty(spark)).count() == 0


def _targets(sizes, share=1.5, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, budget, live = {}, share * sum(sizes.values()), set(order)
    while live:
        w = sum(weight[s] for s in live)
        over = {s for s in live if budget * weight[s] / w >= 2 * sizes[s]} if w else live
        if not over:
            target.update({s: budget * weight[s] / w for s in live})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        budget -= sum(2 * sizes[s] for s in over)
        live -= over
    return target


def test_mixing_meets_its_targets(spark):
    data = [*fx.rows(200), (None, "no id here", None, None, 0)]
    docs = fx.documents(spark, data)
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    sizes, source = defaultdict(int), {}
    for r in data:
        sizes[r[3]] += len(fx.words(r[1]))
        source[r[0]] = r[3]
    target, taken = _targets(sizes), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert [r.position for r in got] == sorted(r.position for r in got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(fx.empty(spark)).count() == 0


def test_mixed_documents_repeat_whole_rows(spark):
    docs = fx.documents(spark, [r for r in fx.rows(100) if r[0] != 3])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.mix(docs).collect():
        assert copies.get(r.doc_id, 0) == (1 if not r["size"] else int(r.taken / r["size"] + 0.5))


def _without(data):
    """(words, removed, kept text) of every row by the definition; rows of equal doc_id don't see each other."""
    first = {}
    rows = [(r[0], fx.words(r[1])) for r in data]
    for d, w in rows:
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if d is not None and d < first.get(g, d + 1):
                first[g] = d
    out = []
    for d, w in rows:
        gone, seen = [False] * len(w), set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen or (d is not None and first[g] < d):
                gone[i : i + 20] = [True] * 20
            seen.add(g)
        out.append((str(d), len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)))
    return out


def test_substring_dedup(spark):
    data = [*fx.rows(100), (None, fx.rows(100)[1][1], None, None, 0)]
    docs = fx.documents(spark, data)
    got = substring_dedup.without_repeats(docs)
    assert got.columns == [*docs.columns, "_n_words", "_n_removed", "_kept"]
    want = _without(data)
    assert sum(x[2] for x in want) > 500
    assert sorted((str(r.doc_id), r._n_words, r._n_removed, r._kept) for r in got.collect()) == sorted(want)
    assert substring_dedup.without_repeats(fx.empty(spark)).count() == 0


def test_substring_dedup_of_shared_doc_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    data = [(i, t, None, None, 0) for i, t in [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c + " " + a), (4, c), (5, c), (6, "x " + b), (6, b)]]
    got = substring_dedup.without_repeats(fx.documents(spark, data)).collect()
    assert sorted((str(r.doc_id), r._n_words, r._n_removed, r._kept) for r in got) == sorted(_without(data))
    assert (2, b) in {(r.doc_id, r._kept) for r in got}


def test_near_duplicates(spark):
    data = [*fx.rows(100), (None, fx.rows(100)[1][1], None, None, 0)]
    got = bag_minhash.near_duplicates(fx.documents(spark, data)).collect()
    assert len(got) == len(data)
    bags = [(r[0], fx.shingles(r[1])) for r in data if r[0] is not None]
    links = []
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            both = sum((x & y).values())
            if both and both / sum((x | y).values()) >= 0.8:
                links.append((a, b))
    assert len(links) > 5
    want = fx.components([r[0] for r in data if r[0] is not None], links)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    assert bag_minhash.near_duplicates(fx.empty(spark)).count() == 0


def test_bag_minhash_is_unbiased():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**60, 300).astype(np.uint64)
    off = []
    for trial in range(40):
        a, b = rng.integers(1, 9, 300), rng.integers(0, 9, 300)
        b = np.where(rng.random(300) < 0.5, a, b)
        there = b > 0
        shingle = np.concatenate((base, base[there])) + np.uint64(trial * 7919)
        sig = bag_minhash.signatures(np.concatenate((np.zeros(300, int), np.ones(there.sum(), int))), shingle, np.concatenate((a, b[there])), 2)
        off.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.02


def _labelled(spark, n=600):
    import random

    rng = random.Random(9)
    clean = ["ther", "andan", "ofin", "lander", "mintho", "solar", "wavend", "toren", "bilit", "cardo", "nester", "quill"]
    data, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = i % 8 == 0
        if toxic:
            w[1:1] = [rng.choice(["idiot", "scum", "worthless"])] if i % 16 else ["zogmanar", "zogmanen", "zogmanut"]
        data.append((i, " ".join(w), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (2, 0, None)]
    return fx.documents(spark, [*data, (None, "no id", None, None, 0), (700, None, None, None, 0), (701, "", None, None, 0)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    told = [(r.predicted, int(r.doc_id % 8 == 0)) for r in got if r.held_out and r.doc_id < 600]
    assert sum(a == b for a, b in told) / len(told) > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (700, 701, None))
    without = toxicity.toxicity(docs, labels.limit(0))
    assert without.where("predicted = 1").count() > 20
    assert toxicity.toxicity(fx.empty(spark), labels).count() == 0


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = _labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    key = lambda df: sorted((str(r.doc_id), round(r.score, 9)) for r in df.collect())
    assert key(toxicity.toxicity(docs, labels)) == key(toxicity.toxicity(docs, flipped))


def test_quality_finds_junk(spark):
    import random

    rng = random.Random(3)
    common, rare = ["the", "of", "and", "to", "in"], ["lander", "minthod", "solar", "wavend", "torent", "biliten"]
    good = lambda: ". ".join(" ".join(rng.choice(common if rng.random() < 0.3 else rare) + ("x" * rng.randint(0, 3)) for _ in range(12)).capitalize() for _ in range(5)) + "."
    junk = [lambda: " ".join(["Es."] * 80), lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: " | ".join(good().replace(".", "").split()), lambda: " ".join(w + rng.choice(["***", "$$$", "&&&"]) for w in good().split())]
    data = [(i, junk[i % 4]() if i % 5 == 0 else good(), "en", "s", 0) for i in range(400)]
    got = quality.quality(fx.documents(spark, [*data, (None, None, None, None, 0), (500, "", None, None, 0)])).collect()
    told = [(r.predicted, int(r.doc_id % 5 > 0)) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert len(got) == 402 and sum(a == b for a, b in told) / len(told) > 0.97
    assert quality.quality(fx.empty(spark)).count() == 0


def test_digest_of_kept_words(spark, tmp_path):
    from lingot.llm import queries

    fx.documents(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op5_seed_and_extend(spark, f"file://{tmp_path}").collect()
    want = sorted((a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in _without(fx.rows()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
