"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from vantage.llm import prefix_trie
from vantage.llm.prefix_trie import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole)))
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + ((len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0)
    low = {key: min(c for c, _ in m) for key, m in members.items()}
    return sorted(
        (low[key], len(key), low[key[:-1]] if key else -1, len(m), len(kids[key]), leaves[key], saved[key],
         hashlib.sha256(",".join(map(str, sorted(c for c, n in m if n == len(key)))).encode()).hexdigest())
        for key, m in members.items())


def got(spark, rows, extra=False):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        frame = frame.selectExpr("*", "1 as b", "'x' as ids", "2 as tx", "3 as rep", "4 as n")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in trie(frame).select(COLUMNS).collect())


def talks(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randrange(longest + 1)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("batch", [10_000, 7, 1])
def test_against_all_prefixes(spark, batch):
    rows = talks(batch, range(-20, 300), 14, ["a", "b", None, "", "ü€", "long " * 40])
    rows += [(400, None, "user", "first"), (400, 0, "user", "a"), (400, 0, "user", "a"), (400, 0, "x", "b"), (None, 1, "user", "lost"), (401, None, None, None)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        assert got(spark, rows, extra=True) == plain(rows)
    finally:
        spark.conf.set(key, before)


def test_long_shared_beginnings(spark, monkeypatch):
    """Conversations over several matrices: shared, forked inside and at their edges, copied, ending at an edge, alone."""
    monkeypatch.setattr(prefix_trie, "DEPTH", 4)
    stem = [f"s{i}" for i in range(30)]
    ends = [stem, stem[:16], stem[:17], [*stem[:16], "x"], [*stem[:14], "y", *stem], stem, [*stem, *["z"] * 9], stem[:12], stem[:8], stem[:3], [*stem[:20], "q", "r"], [f"u{i}" for i in range(40)], [f"u{i}" for i in range(40)]]
    whole_own = [c for c in range(1, 4000) if zlib.crc32(str(c).encode()) % 9 == 0][:2 * len(ends)]
    rows = [(c, t, "user", w) for i, c in enumerate(whole_own) for t, w in enumerate(ends[i % len(ends)])]
    assert got(spark, rows) == plain(rows)


def test_many_copies_and_a_common_first_turn(spark):
    rows = [(c, t, "user", f"same {t}" if c % 3 else f"{c} {t}" if t else "hello") for c in range(900) for t in range(6)]
    assert got(spark, rows) == plain(rows)


def test_one_very_long_conversation_and_text(spark):
    rows = [(5, t, "user", f"t{t % 50}") for t in range(5000)] + [(6, t, "user", f"t{t % 50}") for t in range(300)] + [(7, 0, "user", "é" * 300_000)]
    assert got(spark, rows) == plain(rows)


def test_empty_and_turnless(spark):
    assert got(spark, []) == []
    lone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:4]
    rows = [(c, 0, "user", "gone") for c in lone]
    assert got(spark, rows) == plain(rows)
    assert len(plain(rows)) == 1
