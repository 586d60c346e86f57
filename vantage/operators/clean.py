"""Whole-table cleaning: addresses, descriptions, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.address import clean_address, region_tokens, valid_address
from vantage.functions.score import with_category
from vantage.functions.text import clean_description


def region_counts(addresses: DataFrame, column: str = "address") -> DataFrame:
    """How often each known region appears; at most one row per region in the vocabulary."""
    return (
        addresses.select(F.explode(region_tokens(F.col(column))).alias("region"))
        .groupBy("region").agg(F.count(F.lit(1)).alias("uses"))
    )


def default_region(addresses: DataFrame, column: str = "address"):
    """The most used region as a scalar column, '' when no address names one."""
    top = region_counts(addresses, column).agg(
        F.coalesce(F.max_by("region", F.struct(F.col("uses"), _inverse("region"))), F.lit(""))
    )
    return top.scalar()


def _inverse(column: str):
    """A key that sorts descending where the short upper-case text sorts ascending."""
    return F.transform(F.split(F.col(column), ""), lambda ch: -F.ascii(ch))


def clean_rows(
    events: DataFrame, region=None, description_chars: int | None = None
) -> DataFrame:
    """Re-clean venue, address and description; ``changed`` marks rows that differ."""
    region = default_region(events) if region is None else region
    described = clean_description(F.col("description"))
    if description_chars:
        described = F.substring(described, 1, description_chars)
    out = events.withColumn("_region", region).withColumns({
        "_venue": clean_address(F.coalesce("venue_name", F.lit("")), F.col("_region")),
        "_address": valid_address(F.col("address"), F.col("_region")),
        "_description": described,
    })
    changed = (
        ~F.col("_venue").eqNullSafe(F.col("venue_name"))
        | ~F.col("_address").eqNullSafe(F.col("address"))
        | ~F.col("_description").eqNullSafe(F.col("description"))
    )
    return out.withColumn("changed", changed).withColumns({
        "venue_name": F.col("_venue"), "address": F.col("_address"), "description": F.col("_description"),
    }).drop("_region", "_venue", "_address", "_description")


def reclassify(events: DataFrame, **options) -> DataFrame:
    """Category of every stored row from its text alone."""
    return with_category(events.drop("category"), supplied=None, **options)
