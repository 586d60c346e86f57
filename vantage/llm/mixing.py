"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import beside

SEED = "mix-1"


def uniform(seed: str, key: Column) -> Column:
    """A uniform number in (0, 1) that depends on the seed and the key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


#: Mean from which the walk starts below the mean instead of at 0: the term at 0 is too small for a double from about 708 on.
LARGE = 500


def poisson(mean: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) >= u for a Poisson X: the inverse distribution function, term by term.

    The terms run to 20 + 12 deviations above the mean, beyond which they are below the precision of a double. Above a
    mean of ``LARGE`` they start as far below it, with the term there from Stirling's series for the factorial.
    """
    reach = 12 * F.sqrt(mean) + 20
    last = F.ceil(mean + reach).cast("int")
    low = F.floor(mean - reach)
    # log(low!) = low log(low) - low + log(2 pi low) / 2 + ...; the two large parts are small together.
    log_term = (low * F.log1p((mean - low) / low) - (mean - low) - 0.5 * F.log(2 * math.pi * low)
                - 1 / (12 * low) + 1 / (360 * low * low * low))
    large = mean > LARGE
    first = F.when(large, low).otherwise(0).cast("int")
    term = F.when(large, F.exp(log_term)).otherwise(F.exp(-mean))
    walked = F.aggregate(
        F.sequence(first + 1, last), F.struct(term.alias("term"), term.alias("upto"), first.alias("k")),
        lambda s, k: F.when(s["upto"] >= u, s).otherwise(F.struct(
            (s["term"] * mean / k).alias("term"), (s["upto"] + s["term"] * mean / k).alias("upto"), k.alias("k"),
        )),
    )
    return walked["k"]


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0,
                 source: str = "source") -> DataFrame:
    """(source, n, rate): rows of each source and how often each of them shall appear on average.

    A source's share of the output is its weight over the sum of weights of the sources present; without weights it is
    the square root of its size. The output has ``total`` times as many rows as the input, on average. A source that
    the weights leave out has rate 0; the null source is a source named by null, weighed under "".
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        weight = F.lit(0.0) if table is None else F.coalesce(table[F.coalesce("source", F.lit(""))].cast("double"), F.lit(0.0))
    weighed = sizes.withColumn("w", weight)
    sums = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    # The sums are one row, so this join repeats no row.
    return weighed.join(F.broadcast(sums), F.lit(True)).select(
        "source", "n",
        F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") * F.lit(float(total)) / F.col("n"))
        .otherwise(F.lit(0.0)).alias("rate"),
    )


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: str = SEED,
          doc_id: str = "doc_id", source: str = "source", replica: str | None = "replica",
          place: str | None = "place") -> DataFrame:
    """Every document as many times as a Poisson number with its source's rate says, in a global random order.

    The number and the order key are hashes of the id (and copy number) under ``seed``: a rerun repeats them. ``place``
    is the order key in (0, 1); rows are dealt to partitions by a hash of it and sorted inside, so each output file is
    a random sample of the whole in random order. Rows that repeat an id are replicated alike; an id of null is hashed
    as "null". Input columns are returned as they are, whatever their names; ``replica`` and ``place`` (None: left
    out) replace columns of the same name. An empty table gives an empty table.
    """
    rates = target_rates(docs, weights, total, source).select(F.col("source").alias("_s"), F.col("rate").alias("_rate"))
    rows = docs.select(F.struct("*").alias("_row"))
    drawn = (
        rows.join(beside(rates), F.col(f"_row.`{source}`").eqNullSafe(F.col("_s")))
        .withColumn("_times", poisson(F.col("_rate"), uniform(seed, F.col(f"_row.`{doc_id}`"))))
        .filter(F.col("_times") > 0)
        .withColumn("_replica", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    )
    key = F.concat_ws(":", F.coalesce(F.col(f"_row.`{doc_id}`").cast("string"), F.lit("null")), "_replica")
    shuffled = drawn.withColumn("_place", uniform(f"{seed}-order", key)).repartition("_place").sortWithinPartitions("_place", "_replica")
    added = [F.col(x).alias(y) for x, y in (("_replica", replica), ("_place", place)) if y]
    return shuffled.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in (replica, place)], *added)
