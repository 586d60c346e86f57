"""One event per group of listings.

A group may hold any number of listings, so scalar fields come from partial
aggregates and the listings themselves stay in long tables keyed by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.address import locality_of
from vantage.functions.times import utc_date

FIRST_NON_EMPTY = ["title", "venue_name", "address", "category", "price_text", "url"]


def group_key() -> Column:
    return (
        F.when(F.coalesce(F.col("manual_group"), F.lit("")) != "", F.col("manual_group"))
        .when(F.coalesce(F.col("dedupe_group"), F.lit("")) != "", F.col("dedupe_group"))
        .otherwise(F.concat(F.lit("solo-"), F.col("id").cast("string")))
    )


def with_group(events: DataFrame) -> DataFrame:
    return events.withColumn("group_key", group_key())


def _first(value: Column, present: Column, *order: str) -> Column:
    """Smallest (order..., value) among the rows where ``present`` holds."""
    return F.min(F.when(present, F.struct(*[F.col(c) for c in order], value.alias("v"))))


def merged_heads(events: DataFrame) -> DataFrame:
    """One row per group. Expects group_key (see with_group).

    Two aggregation levels: per (group, day) and then per group, which also
    yields the day most listings agree on.
    """
    src = events.select(
        "group_key", "id", "source", "start_ts", "end_ts", "description", "lat", "lng", "image_url",
        "is_online", "starred", "hidden", "photo_score", "manual_group", *FIRST_NON_EMPTY,
    ).withColumns({"_day": utc_date(F.col("start_ts")), "_short": -F.length("description")})
    order = ("start_ts", "id")
    picks = {c: _first(F.col(c), F.col(c) != "", *order) for c in FIRST_NON_EMPTY}
    picks |= {c: _first(F.col(c), F.col(c).isNotNull(), *order) for c in ("end_ts", "lat", "lng")}
    picks["cover"] = _first(F.col("image_url"), F.col("image_url") != "", *order)
    picks["description"] = _first(F.col("description"), F.col("description") != "", "_short", *order)
    picks["manual"] = _first(F.col("manual_group") != "", F.lit(True), *order)
    daily = src.groupBy("group_key", "_day").agg(
        F.count(F.lit(1)).alias("_n"), F.min("start_ts").alias("_start"),
        F.bool_and("is_online").alias("is_online"), F.bool_or("starred").alias("starred"),
        F.bool_or("hidden").alias("hidden"), F.max("photo_score").alias("photo_score"),
        # As many values as there are source adapters.
        F.collect_set("source").alias("_sources"),
        *[col.alias(f"_p_{name}") for name, col in picks.items()],
    )
    total = daily.groupBy("group_key").agg(
        F.sum("_n").alias("member_count"),
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_day"), F.col("_start"))).alias("_agreed"),
        F.bool_and("is_online").alias("is_online"), F.bool_or("starred").alias("starred"),
        F.bool_or("hidden").alias("hidden"), F.max("photo_score").alias("photo_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sources")))).alias("source_names"),
        *[F.min(f"_p_{name}").alias(f"_p_{name}") for name in picks],
    )
    text = lambda name: F.coalesce(F.col(f"_p_{name}.v"), F.lit("")).alias(name)
    heads = total.select(
        "group_key", text("title"), text("description"), F.col("_agreed._start").alias("start_ts"),
        F.col("_p_end_ts.v").alias("end_ts"), text("venue_name"), text("address"),
        F.col("_p_lat.v").alias("lat"), F.col("_p_lng.v").alias("lng"), text("cover"), text("category"),
        text("price_text"), text("url"), "is_online", "photo_score", "starred", "hidden", "source_names",
        F.col("_p_manual.v").alias("manual"), "member_count",
    )
    by_address, by_venue = locality_of(F.col("address")), locality_of(F.col("venue_name"))
    return heads.withColumn("_by_address", by_address).withColumn(
        "locality", F.when(F.col("_by_address") != "", F.col("_by_address")).otherwise(by_venue)
    ).drop("_by_address")


def merged_members(events: DataFrame) -> DataFrame:
    """The listings behind each group, one row each; order inside a group is (start_ts, id)."""
    return events.select("group_key", "start_ts", "id", "source", "title", "url", "image_url", "venue_name")


def merged_images(events: DataFrame) -> DataFrame:
    """Distinct images per group with the first listing that carries each."""
    return (
        events.filter(F.col("image_url") != "").groupBy("group_key", "image_url")
        .agg(F.min(F.struct("start_ts", "id")).alias("_first"))
        .select("group_key", "image_url", F.col("_first.start_ts").alias("first_start_ts"),
                F.col("_first.id").alias("first_id"))
    )


def member_positions(events: DataFrame) -> DataFrame:
    """The listings behind each group with their zero-based ``position`` in (start_ts, id) order.

    Rows are counted per group and day first, so no group is sorted as a whole.
    """
    daily = merged_members(events).withColumn("_day", F.to_date("start_ts"))
    before = Window.partitionBy("group_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = daily.groupBy("group_key", "_day").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").withColumnsRenamed({"group_key": "_group", "_day": "_on"})
    inside = F.row_number().over(Window.partitionBy("group_key", "_day").orderBy("start_ts", "id")) - 1
    numbered = daily.withColumn("_row", inside)
    return numbered.join(
        offsets, (F.col("group_key") == F.col("_group")) & F.col("_day").eqNullSafe(F.col("_on"))
    ).withColumn("position", F.col("_before") + F.col("_row")).drop("_day", "_on", "_group", "_before", "_row")


def group_rows(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows behind the group keys in ``wanted`` (group_key), whichever kind each key is."""
    return with_group(events).join(wanted.select("group_key").distinct(), "group_key", "left_semi")
