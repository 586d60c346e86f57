"""Substring dedup against a dictionary of all strings."""

import random

import numpy as np
import pytest
import xxhash

from vantage.llm.suffixes import deduplicated, joined_spans, merged


def brute(rows, length):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        b = t.encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s:s + length], (i, s))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if i is not None and first[b[s:s + length]] != (i, s):
                gone[s:s + length] = b"\1" * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def check(spark, rows, length=20, k=8, part_rows=150_000):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = deduplicated(frame, length=length, k=k, part_rows=part_rows).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute(rows, length)


def made(seed, n=150):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé ", k=rng.randrange(10, 80))) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif kind < 0.3:
            text = rng.choice("ab") * rng.randrange(60)
        else:
            text = "".join(rng.choice([rng.choice(passages), "".join(rng.choices("abcdefgh\0\n", k=rng.randrange(40)))]) for _ in range(rng.randrange(6)))
        rows.append((7 * i % 1009, text))
    return rows


def test_against_all_strings(spark):
    check(spark, made(1))


def test_hot_anchors_take_the_other_way(spark):
    check(spark, made(2), part_rows=40)


def test_hot_anchors_without_a_repeat_in_their_slice(spark):
    text = "".join(random.Random(3).choices("abcdefgh", k=60))
    check(spark, [(i, text) for i in (1, 2, 3)], part_rows=1)
    assert joined_spans(np.zeros(0, np.int64), np.zeros(0, np.int64), 20).shape == (0, 3)


def test_default_length(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghij ", k=400)) for _ in range(5)]
    rows = [(i, rng.choice(base)[rng.randrange(200):][:rng.randrange(90, 300)] + "".join(rng.choices("xyz", k=rng.randrange(90)))) for i in range(80)]
    check(spark, rows, 100, 40)


def test_nulls_empty_long_and_repeats(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abc", k=30_000))
    check(spark, [(3, None), (4, ""), (5, long), (2, long[500:20_000]), (9, "é" * 50), (None, long[:100])])
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    twice = spark.createDataFrame([(1, "a" * 10 + "bcdefghij" * 3, 5, "x")] * 2, "doc_id long, text string, lo long, kept string")
    assert {(r["n_removed"], r["n_spans"]) for r in deduplicated(twice, length=20, k=8).collect()} == {(brute([(1, "a" * 10 + "bcdefghij" * 3)], 20)[1][1:3])}


@pytest.mark.parametrize("part_rows", [150_000, 40])
def test_equal_ids_with_different_texts(spark, part_rows):
    rng = random.Random(9)
    same = "".join(rng.choices("abcdefgh", k=300))
    rows = [(1, same), (2, "zz" + same), (2, "".join(rng.choices("mnopqrst", k=400))), (3, "yy" + same[:200]), (3, None), (2, None), (None, same)]
    texts = [t for _, t in made(10, 60)]
    rows += [(rng.randrange(5, 20), t) for t in texts]
    rows += rng.choices(rows, k=10)
    order = {key: n for n, key in enumerate(sorted(
        {r for r in rows if None not in r}, key=lambda r: (r[0], (xxhash.xxh64_intdigest(r[1], 42) + 2**63) % 2**64)))}
    plain = brute([(n, r[1]) for r, n in order.items()], 20)
    untouched = lambda t: (len((t or "").encode()), 0, 0, (t or "").encode())
    expected = sorted(((r[0] or 0), *(plain[order[r]] if r in order else untouched(r[1]))) for r in rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = deduplicated(frame, length=20, k=8, part_rows=part_rows).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == expected
    assert (2, 400, 0, 0) in {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got}


def test_loser_tree():
    rng = random.Random(7)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted({bytes(rng.choices(b"\0ab", k=rng.randrange(8))) for _ in range(rng.randrange(30))}) for _ in range(k)]
        def front(run):
            before = b""
            for s in run:
                same = next((i for i, (x, y) in enumerate(zip(before, s, strict=False)) if x != y), min(len(before), len(s)))
                yield same, s
                before = s
        order, at, before = list(merged([front(r) for r in runs])), [0] * k, b""
        out = []
        for r, lcp in order:
            s = runs[r][at[r]]
            at[r] += 1
            assert lcp == next((i for i, (x, y) in enumerate(zip(before, s, strict=False)) if x != y), min(len(before), len(s)))
            out.append(s)
            before = s
        assert out == sorted(x for r in runs for x in r)
