"""Importance resampling against a count of every n-gram in plain Python."""

import math
import random
from collections import Counter

import numpy as np

from vantage.llm import resampling as m
from vantage.llm.resampling import kth_largest, ngrams, resampled


def buckets(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return Counter(ngrams(raw, np.array([0, len(raw)]))[1].tolist())


def made():
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.randrange(1, 60)))) for i in range(300)]
    return rows + [(300, None), (301, "")], [(i, i % 2, 0) for i in range(0, 200)] + [(7, 1, None), (None, 1, 0), (5, None, 0)]


def test_weights_and_selection(spark):
    rows, labels = made()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    got = resampled(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), share=0.4).collect()
    target = {i for i, q, t in labels if i is not None and q == 1 and not t}
    own, raw = np.ones(m.BUCKETS), np.ones(m.BUCKETS)
    for i, t in rows:
        for b, n in buckets(t).items():
            raw[b] += n
            own[b] += n * (i in target)
    ratio = np.log(own / own.sum()) - np.log(raw / raw.sum())
    for r in got:
        c = buckets(dict(rows)[r["doc_id"]])
        assert math.isclose(r["log_weight"], m.DRAWN * sum(ratio[b] * n for b, n in c.items()) / (sum(c.values()) + m.SHRINK), abs_tol=1e-9)
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    assert [r["selected"] for r in sorted(got, key=lambda r: -r["gumbel_key"])] == [k >= keys[round(len(rows) * 0.4) - 1] for k in keys]
    assert sum(r["selected"] for r in got if r["doc_id"] % 2) > 100


def test_words_and_pairs_stay_in_their_text():
    raw = np.frombuffer(b"a b\tA B c", np.uint8)
    rows, bucket = ngrams(raw, np.array([0, 4, 4, 9]))
    assert sorted(rows.tolist()) == [0, 0, 0, 2, 2, 2, 2, 2]
    assert set(bucket[rows == 0]) < set(bucket[rows == 2])


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.randrange(-10**12, 10**12) for _ in range(500)] + [5, 5, 5, -1, 0, -(1 << 60), 1 << 60]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 77, len(values)):
        assert kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(frame, "v", 0) is None and kth_largest(frame, "v", len(values) + 1) is None


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampled(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []
    got = resampled(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), labels, share=1.0).collect()
    assert {(r["log_weight"], r["selected"]) for r in got} == {(0.0, True)}
