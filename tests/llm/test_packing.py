"""Packing against the tokenizer's own ids of whole texts, and an exact round trip."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vantage.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary())


def rebuilt(pieces, rows, tokenizer):
    """Checks that the pieces are the documents and the sequences whole; returns the sequences."""
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc, len(ids)] += 1
    of, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], p["ids_crc32"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"], p["doc_id"]))
    assert set(of) == set(want)
    texts = defaultdict(list)
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        texts[doc, len(ids)].append(ids)
    for key, found in of.items():
        if want[key] == 1:
            at = 0
            for start, length, crc in sorted(found):
                assert start == at and length > 0 and crc == zlib.crc32(texts[key][0][at:at + length].tobytes())
                at += length
            assert at == key[1]
        else:
            assert sum(n for _, n, _ in found) == key[1] * want[key]
            cover = Counter(i for start, n, _ in found for i in range(start, start + n))
            assert set(cover.values()) == {want[key]}
            assert all(any(crc == zlib.crc32(x[s:s + n].tobytes()) for x in texts[key]) for s, n, crc in found)
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0 and at < packing.WINDOW
    return sequences


def test_round_trip(spark, tokenizer):
    rng = random.Random(5)
    words = ["Hello", "it's", "naïve", "漢字仮名", "éa", "́x", "don't!", "x1y2", "🙂🙂", "<|endoftext|>", "a<|startoftext|>b", "ΣΑΣ", "İ", " nb sp", "'re", "\x1c\x1f", "re", "ﬁ"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b", "\x0c\r", ""]) for _ in range(rng.randrange(400)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, "no id"), (7, "again"), (7, "again"), (7, "other words"), (8, "big " * 60_000), (9, "x" * 30_000)]
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, tokens string, route int")
    for shard in (packing.SHARD, 5000):
        sequences = rebuilt(packing.packed(frame, shard=shard).collect(), rows, tokenizer)
        full = sum(sum(n for _, n, _ in s) == packing.WINDOW for s in sequences.values())
        # Of each shard less than a window is left, in at most eleven sequences.
        assert len(sequences) - full <= 11 * (1 if shard == packing.SHARD else 60)


def test_neighbours_share_words(spark, tokenizer):
    """Four kinds of text with words of their own: most of a window is of one kind."""
    rng = random.Random(6)
    kinds = [[f"{a}{b}{c}" for a in first for b in "aeiou" for c in second] for first, second in (("bcd", "ptk"), ("fgh", "mnr"), ("jkl", "swz"), ("vxy", "dbg"))]
    rows = [(i, " ".join(["the", "of"] * 20 + rng.choices(kinds[i % 4], k=rng.randrange(60, 300)))) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sequences = rebuilt(packing.packed(frame).collect(), rows, tokenizer)
    share = [max(c.values()) / packing.WINDOW for s in sequences.values() if sum(n for _, n, _ in s) == packing.WINDOW for c in [sum((Counter({d % 4: n}) for _, n, d in s), Counter())]]
    assert sum(share) / len(share) > 0.9


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_scores_against_plain_bm25(tokenizer):
    rng = random.Random(7)
    texts = [np.array(rng.choices(range(2, 60), k=rng.randrange(1, 80)), np.uint16) for _ in range(60)]
    n = np.zeros(64, np.int64)
    for t in texts:
        n[np.unique(t)] += 1
    rarity, mean = np.log1p((60 - n + 0.5) / (n + 0.5)), sum(map(len, texts)) / 60
    shard = packing.Shard([[i, len(t), 0, t, 0] for i, t in enumerate(texts)], rarity, mean)
    for seed in range(60):
        best = sorted(set(texts[seed].tolist()), key=lambda w: (-rarity[w] * (c := texts[seed].tolist().count(w)) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(texts[seed]) / mean)), w))[:packing.ASKED]
        score = [sum(rarity[w] * (c := t.tolist().count(w)) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in best) for t in texts]
        order = shard.neighbours(seed)
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(order, order[1:]))
