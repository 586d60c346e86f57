"""Upserts of events and venues, and the versioned Parquet tables they live in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators.ranking import ordered_positions
from vantage.session import checkpointed

EVENT_KEY = ["source", "source_id"]
CONTENT = [
    "title", "description", "start_ts", "end_ts", "venue_name", "address", "lat", "lng", "url",
    "image_url", "category", "price_text", "is_online", "photo_score", "last_seen_at",
]
KEPT_DEFAULTS = {
    "starred": "false", "hidden": "false", "dedupe_group": "''", "manual_group": "''",
    "archived": "false", "archived_at": "cast(null as timestamp)", "geocode_tried": "false",
}


def last_per_key(incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a plain aggregate, so repeats shrink before the shuffle."""
    rest = [c for c in incoming.columns if c not in key]
    return (
        incoming.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*key, "_row.*")
    )


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*key, "_row.*")
    )


def upsert_events(
    current: DataFrame, incoming: DataFrame, order: list[str], strict: bool = False,
    title_chars: int | None = None, description_chars: int | None = None, top: int | None = None,
) -> DataFrame:
    """Merge incoming rows into the current table on (source, source_id).

    Content columns are overwritten; flags, groups, archive state and id stay.
    A position the new row lacks is kept from the old row unless ``strict``.
    New rows get ids after the largest existing one (or after ``top``, where
    ``current`` is a part of a table), in (first order column, source,
    source_id) order. Either side is read once: one outer join, checkpointed,
    holds the old ids and the rows that still need one.
    """
    cut = lambda c, n: F.substring(c, 1, n) if n else c
    fresh = last_per_key(incoming.select(*EVENT_KEY, *CONTENT, *[c for c in order if c not in CONTENT]),
                         EVENT_KEY, order)
    fresh = fresh.withColumns({
        "_order": F.col(order[0]), "_new": F.lit(True),
        "title": cut(F.col("title"), title_chars),
        "description": cut(F.col("description"), description_chars),
    })
    joined = current.alias("old").join(fresh.alias("new"), EVENT_KEY, "full_outer")
    is_new = F.coalesce(F.col("new._new"), F.lit(False))

    def content(c: str) -> Column:
        new, old = F.col(f"new.{c}"), F.col(f"old.{c}")
        if c in ("lat", "lng") and not strict:
            return F.when(is_new, F.coalesce(new, old)).otherwise(old).alias(c)
        return F.when(is_new, new).otherwise(old).alias(c)

    joined = checkpointed(joined.select(
        F.col("old.id").alias("id"), *EVENT_KEY, *[content(c) for c in CONTENT],
        *[F.coalesce(F.col(f"old.{c}"), F.expr(default)).alias(c) for c, default in KEPT_DEFAULTS.items()], "_order",
    ))
    if top is None:
        top = joined.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    unseen = ordered_positions(joined.filter("id is null"), ["_order", *EVENT_KEY], "_position")
    numbered = unseen.withColumn("id", F.col("_position") + 1 + F.lit(top)).drop("_position")
    return joined.filter("id is not null").unionByName(numbered).drop("_order")


def upsert_venues(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Venue upsert on (area, cid) that never replaces a known profile with null."""
    overwrite = ["name", "kgmid", "lat", "lon", "term"]
    joined = current.alias("old").join(
        incoming.withColumn("_new", F.lit(True)).alias("new"), ["area", "cid"], "full_outer"
    )
    is_new = F.coalesce(F.col("new._new"), F.lit(False))
    return joined.select(
        "area", "cid",
        *[F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in overwrite],
        F.coalesce("new.profile", "old.profile").alias("profile"),
        F.coalesce(F.col("old.barren_streak"), F.lit(0)).alias("barren_streak"),
    )


def replace_venues(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Venue list of the areas present in ``incoming``: departed ones gone, profiles carried over."""
    old = current.select("area", "cid", F.col("profile").alias("_profile"), F.col("barren_streak").alias("_streak"))
    fresh = incoming.join(old, ["area", "cid"], "left")
    return fresh.select(
        "area", "cid", "name", "kgmid", "lat", "lon", "term",
        F.coalesce("profile", "_profile").alias("profile"),
        F.coalesce(F.col("_streak"), F.lit(0)).alias("barren_streak"),
    )


def departed_venues(current: DataFrame, incoming: DataFrame) -> DataFrame:
    areas = incoming.select("area").distinct()
    return current.join(areas, "area", "left_semi").join(incoming, ["area", "cid"], "left_anti")


# --- versioned tables --------------------------------------------------------------


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a table, None before the first write."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def write_next(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a new version beside the ones being read; it counts once its _SUCCESS file exists."""
    found = _versions(df.sparkSession, path)
    target = f"{path}/version={(found[-1] if found else 0) + 1}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target
