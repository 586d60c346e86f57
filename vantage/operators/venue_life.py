"""Venue lifecycle: choosing, polling and retiring watched venues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.shoot import panel_wait_ms

PINNED_LINK = "pinned link"


def barren_streaks(checks: DataFrame) -> DataFrame:
    """Consecutive checks without a panel since each venue's last hit.

    ``checks`` has (area, cid, check_id, saw_panel), check_id ascending in time.
    """
    key = ["area", "cid"]
    last_hit = checks.groupBy(*key).agg(F.max(F.when(F.col("saw_panel"), F.col("check_id"))).alias("_hit"))
    missed = (~F.col("saw_panel")) & (F.col("_hit").isNull() | (F.col("check_id") > F.col("_hit")))
    return checks.join(last_hit, key).groupBy(*key).agg(F.count_if(missed).cast("int").alias("barren_streak"))


def round_robin(venues: DataFrame, limit: int | None, position: str = "pos", group: list[str] | None = None) -> DataFrame:
    """One venue from each term in turn, up to ``limit`` per group.

    Equals ordering by (place within the term, first position of the term). No
    term can contribute more than ``limit``, so each map task forwards at most
    that many rows per term.
    """
    if limit is None:
        return venues
    group = group or []
    turn = Window.partitionBy(*group, "term").orderBy(position)
    first = venues.groupBy(*group, "term").agg(F.min(position).alias("_term_pos"))
    candidates = venues.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= limit)
    candidates = candidates.join(first, [*group, "term"])
    if not group:
        return candidates.orderBy("_turn", "_term_pos").limit(limit).drop("_turn", "_term_pos")
    place = Window.partitionBy(*group).orderBy("_turn", "_term_pos")
    return candidates.withColumn("_place", F.row_number().over(place)).filter(
        F.col("_place") <= limit
    ).drop("_turn", "_term_pos", "_place")


def choose_venues(
    found: DataFrame, linked: DataFrame, pinned_names: list[str], max_venues: int | None,
    per_name: int = 2, position: str = "pos",
) -> DataFrame:
    """Venues of one area to watch: linked ones, a few per pinned name, then round robin over terms."""
    columns = found.columns
    by_name = Window.partitionBy("term").orderBy(position)
    pinned = (
        found.filter(F.col("term").isin(pinned_names))
        .withColumn("_n", F.row_number().over(by_name)).filter(F.col("_n") <= per_name).drop("_n")
    )
    fixed = linked.select(*columns).unionByName(pinned)
    rest = found.join(fixed.select("cid"), "cid", "left_anti").select(*columns)
    if max_venues is None:
        return fixed.unionByName(rest)
    # The fixed part is small: the links a person pasted and a few venues per pinned name.
    room = max(0, max_venues - fixed.count())
    return fixed.unionByName(round_robin(rest, room, position).select(*columns))


def pinned_first(venues: DataFrame, limit: int | None, position: str = "pos") -> DataFrame:
    ordered = venues.orderBy((F.col("term") == PINNED_LINK).desc(), position)
    return ordered if limit is None else ordered.limit(limit)


def venues_per_term(venues: DataFrame) -> DataFrame:
    return venues.groupBy("area", "term").agg(F.count(F.lit(1)).alias("venues"))


def polling_cost(venues: DataFrame, full_ms: int = 13_000, delay_ms: int = 2_000) -> DataFrame:
    """Per area: venues, quick-checked venues and estimated minutes of a pass."""
    wait = panel_wait_ms(F.col("barren_streak"), full_ms)
    each: Column = F.lit(delay_ms + 2_000) + wait / 2.0
    return venues.groupBy("area").agg(
        F.count(F.lit(1)).alias("venues"), F.count_if(wait < full_ms).alias("quick_checked"),
        F.floor(F.sum(each) / 60_000 + 0.5).alias("minutes"),
    )
