"""Poisson replication against its own arithmetic row by row."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from vantage.llm.mixing import SEED, mixed, poisson, target_rates


def number(seed, key):
    return (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48


def times(mean, u):
    k, term = 0, math.exp(-mean)
    upto = term
    while upto < u and k < math.ceil(mean + 12 * math.sqrt(mean) + 20):
        k += 1
        term *= mean / k
        upto += term
    return k


def test_copies_and_order(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 5}", "x") for i in range(600)] + [(1000, None, None, None), (None, "null id", "big", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _place string")
    got = mixed(frame).collect()
    sizes = Counter(r[2] for r in rows)
    weight = {s: math.sqrt(n) for s, n in sizes.items()}
    want = Counter()
    for r in rows:
        mean = weight[r[2]] / sum(weight.values()) * len(rows) / sizes[r[2]]
        want[r] = times(mean, number(SEED, "null" if r[0] is None else r[0]))
    assert Counter(tuple(r)[:4] for r in got) == +want
    assert all(abs(r["place"] - number(f"{SEED}-order", f"{'null' if r['doc_id'] is None else r['doc_id']}:{r['replica']}")) < 1e-12 for r in got)


def test_rates_weights_and_edges(spark):
    frame = spark.createDataFrame([(i, "a" if i < 75 else "b") for i in range(100)] + [(100, "c")], "doc_id long, source string")
    rates = {r["source"]: r["rate"] for r in target_rates(frame, {"a": 1.0, "b": 3.0}, total=2.0).collect()}
    assert abs(rates["a"] * 75 - 50.5) < 1e-9 and abs(rates["b"] * 25 - 151.5) < 1e-9 and rates["c"] == 0
    assert mixed(frame, {"zzz": 1.0}).collect() == []
    assert mixed(frame.limit(0)).collect() == []


def test_poisson_mean(spark):
    for mean in (0.1, 1.0, 7.5, 120.0):
        u = (F.col("id") + 0.5) / 4000
        got = spark.range(4000).agg(F.avg(poisson(F.lit(mean), u))).first()[0]
        assert abs(got - mean) < 0.02 + mean * 0.002


def test_large_means(spark):
    for mean in (499.0, 501.0, 700.0, 800.0, 1000.0, 5000.0):
        got = [r[0] for r in spark.range(4000).select(poisson(F.lit(mean), (F.col("id") + 0.5) / 4000)).collect()]
        # The distribution function, summed apart with the logarithms of the terms.
        upto, want, k = 0.0, [], -1
        for i in range(4000):
            while upto < (i + 0.5) / 4000 - 1e-9:
                k += 1
                upto += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            want.append(k)
        assert got == want
        assert abs(sum(got) / 4000 - mean) < 0.02 * math.sqrt(mean)
        assert abs(sum((x - mean) ** 2 for x in got) / 4000 / mean - 1) < 0.02


def test_large_rate_of_a_rare_source(spark):
    frame = spark.createDataFrame([(i, "rare" if i < 3 else "rest") for i in range(6000)], "doc_id long, source string")
    copies = {r["doc_id"]: r["count"] for r in mixed(frame, {"rare": 1.0, "rest": 1.0}).filter("source = 'rare'").groupBy("doc_id").count().collect()}
    assert len(set(copies.values())) > 1 and all(abs(n - 1000) < 160 for n in copies.values())
