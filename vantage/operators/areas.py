"""The areas a job searches, from settings and a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.text import trim_all
from vantage.operators.validate import Area


def event_areas(extra: DataFrame, gazetteer: DataFrame, radius_km: float, home: Area | None = None) -> DataFrame:
    """(position, name, lat, lng, radius_km): the home area first, then the extra ones (position, name, lat, lng, radius_km).

    A name without a position takes the first hit of the gazetteer (query, hits; lower-cased queries) and goes when
    there is none; so do blank names. An area without a radius inherits ``radius_km``.
    """
    named = extra.withColumn("name", trim_all(F.coalesce("name", F.lit("")))).filter(F.col("name") != "")
    answers = gazetteer.select(F.col("query").alias("_key"), F.try_element_at("hits", F.lit(1)).alias("_hit"))
    bare = F.col("lat").isNull() | F.col("lng").isNull()
    placed = named.withColumn("_key", F.when(bare, F.lower("name"))).join(answers, "_key", "left").select(
        "position", "name", F.when(bare, F.col("_hit.lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(bare, F.col("_hit.lng")).otherwise(F.col("lng")).alias("lng"), F.coalesce("radius_km", F.lit(float(radius_km))).alias("radius_km"),
    ).filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    if home is None:
        return placed
    first = extra.sparkSession.createDataFrame(
        [(-1, home.name, home.lat, home.lng, home.radius_km)], "position long, name string, lat double, lng double, radius_km double")
    return first.unionByName(placed.withColumn("position", F.col("position").cast("long")))
