"""The listing pipeline: raw rows in, current event table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.address import clean_address, valid_address
from vantage.functions.score import photo_score, with_category
from vantage.functions.text import clean_description
from vantage.operators.clean import clean_rows, default_region, reclassify
from vantage.operators.dedupe import assign_groups
from vantage.operators.merge import upsert_events
from vantage.operators.place import apply_placements, place_events, placement_backlog
from vantage.operators.validate import Area, archive_past, purge_archived, repair_dates, split_valid
from vantage.operators.venues import canonical_names, localities, rewrite_venues, spelling_counts
from vantage.session import checkpointed


def prepare(raw: DataFrame, current: DataFrame, seen_at: Column) -> DataFrame:
    """Clean, classify and score accepted raw rows for the merge.

    The photo score reads the description and category as the source sent them.
    """
    scored = raw.withColumn("photo_score", photo_score(
        F.col("title"), F.col("description"), F.col("category"), F.col("image_url"), F.col("is_online")
    ).cast("double"))
    categorised = with_category(scored.withColumnRenamed("category", "_supplied"), supplied="_supplied")
    region = categorised.withColumn("_region", default_region(current.filter(F.col("address") != "")))
    return region.withColumns({
        "description": clean_description(F.col("description")),
        "venue_name": clean_address(F.coalesce("venue_name", F.lit("")), F.col("_region")),
        "address": valid_address(F.col("address"), F.col("_region")), "last_seen_at": seen_at,
    }).drop("_region", "_supplied")


def refresh(
    raw: DataFrame, current: DataFrame, gazetteer: DataFrame, areas: list[Area], as_of: Column,
    order: list[str], strict_upsert: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(new event table, rejected rows). The steps build on each other and their order matters:
    cleaned addresses and unified venue names feed the placement, positions feed the grouping.
    """
    accepted, rejected = split_valid(raw, as_of, areas)
    events = upsert_events(current, prepare(accepted, current, as_of), order, strict_upsert)
    events = checkpointed(clean_rows(repair_dates(events)).drop("changed"))
    towns = localities([a.name for a in areas], events.filter(F.col("address") != ""))
    events = rewrite_venues(events, canonical_names(spelling_counts(events), towns))
    events = reclassify(purge_archived(archive_past(events, as_of), as_of))
    events = checkpointed(events)
    events = apply_placements(events, place_events(placement_backlog(events), gazetteer, areas))
    return assign_groups(events), rejected
