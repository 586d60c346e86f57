"""The Jaccard join against a loop over all pairs."""

import random
import re

import numpy as np

from vantage.llm.common import PIECE, PIECES, joined, pieces
from vantage.llm.jaccard import similar_classes


def brute(rows, words=5, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def made(seed, n):
    rng, rows = random.Random(seed), []
    vocab = [f"w{k}" for k in range(60)]
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.6:
            words = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(words) + 1)
                words[k:k + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 5, 6, 12, 40, 90])))))
    return rows


def check(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_against_all_pairs(spark):
    check(spark, [(3 * i + 1, t) for i, t in made(1, 400)])


def test_case_space_nulls_and_long_text(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(9, "A b\tC  d E"), (4, "a B c\nd e"), (5, None), (6, ""), (7, " \n "), (8, None), (1, "Zwei"), (2, "zwei"), (3, "É"), (10, "é"),
            (11, "a b c d e f"), (12, long), (13, long + " y"), (-4, "minus one two three four five"), (20, "minus one two three four five")]
    check(spark, rows)


def test_large_group_of_copies_and_common_passage(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    base = [f"q{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i % 50], "new", *base[i % 50:]])) for i in range(150)]
    rows += [(1000 + i, passage + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(30))) for i in range(150)]
    rows += [(2000 + i, passage) for i in range(50)]
    check(spark, rows)


def test_empty_table_extra_columns_and_repeats(spark):
    assert similar_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f", 7, "x"), (1, "a b c d e f", 7, "x"), (None, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y")]
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string, n long, digest string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(["(1, 2, 1)", "(1, 2, 1)", "(None, 2, None)", "(2, 2, 1)"])


def test_no_worker_but_arrow(spark, monkeypatch):
    """Sketches are joined without RDD functions, whose workers would stand beside those of the Arrow functions."""
    from pyspark.core.rdd import RDD

    def refused(*_, **__):
        raise AssertionError("an RDD function was used")

    monkeypatch.setattr(RDD, "treeAggregate", refused)
    rows = made(3, 60)
    out = similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def test_joined_pieces(spark):
    rng = np.random.default_rng(5)
    arrays = [rng.integers(0, 9, 3 * PIECE + 7) for _ in range(9)]
    rows = spark.createDataFrame([(k,) for k in range(len(arrays))], "k int").repartition(4)

    def made_pieces(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pieces(arrays[k])

    found = joined(rows.mapInArrow(made_pieces, PIECES), np.int64, np.add, 3 * PIECE + 7)
    assert (found == sum(arrays)).all()
    assert not joined(rows.limit(0).mapInArrow(made_pieces, PIECES), np.int64, np.add, 5).any()
