"""Filters, orderings and headings over merged events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.address import place_label
from vantage.functions.geo import haversine_km
from vantage.functions.text import decode_entities, host_of, mentions, social_profile, urls_in
from vantage.functions.times import date_window
from vantage.operators.validate import days, hours


@dataclass(frozen=True)
class Filters:
    chip: str = "all"
    category: str = ""
    source: str = ""
    search: str = ""
    hide_online: bool = True
    show_hidden: bool = False
    starred_only: bool = False


def apply_filters(events: DataFrame, f: Filters, as_of: Column, tz: str) -> DataFrame:
    tests = []
    if not f.show_hidden:
        tests.append(~F.col("hidden"))
    if f.starred_only:
        tests.append(F.col("starred"))
    if f.hide_online:
        tests.append(~F.col("is_online"))
    if f.category:
        tests.append(F.col("category") == f.category)
    if f.source:
        tests.append(F.array_contains("source_names", f.source))
    window = date_window(f.chip, as_of, tz)
    if window:
        tests.append((F.col("start_ts") >= window[0]) & (F.col("start_ts") < window[1]))
    if f.search.strip():
        tests.append(mentions(F.concat_ws(" ", "title", "venue_name", "description"), f.search))
    for test in tests:
        events = events.filter(test)
    return events


def feed_events(events: DataFrame, as_of: Column, starred_only: bool = False, category: str = "",
                n_days: int = 0) -> DataFrame:
    """What a calendar subscription carries."""
    out = events.filter(~F.col("hidden"))
    if starred_only:
        out = out.filter("starred")
    if category:
        out = out.filter(F.col("category") == category)
    return out.filter(F.col("start_ts") <= as_of + days(n_days)) if n_days > 0 else out


def shortlist(events: DataFrame, as_of: Column) -> DataFrame:
    return events.filter(F.col("starred") & ~F.col("hidden") & (F.col("start_ts") >= as_of - hours(1)))


def top_shortlist(events: DataFrame, as_of: Column, n: int = 8) -> DataFrame:
    """First ``n`` of the shortlist with the count of all of it and of the overflow."""
    chosen = shortlist(events, as_of)
    total = chosen.agg(F.count(F.lit(1))).scalar()
    return chosen.orderBy("start_ts", "group_key").limit(n).withColumns({
        "shortlisted": total, "overflow": F.greatest(F.lit(0), total - n),
    })


# --- orderings -------------------------------------------------------------------------


def by_date(events: DataFrame, newest_first: bool = False) -> DataFrame:
    start = F.col("start_ts")
    return events.orderBy(start.desc() if newest_first else start.asc(), "group_key")


def by_photo_score(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("photo_score").desc(), "start_ts", "group_key")


def with_distance(events: DataFrame, lat: float | None, lng: float | None) -> DataFrame:
    if lat is None or lng is None:
        return events.withColumn("distance_km", F.lit(None).cast("double"))
    return events.withColumn("distance_km", haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))


def by_distance(events: DataFrame, lat: float | None, lng: float | None) -> DataFrame:
    return with_distance(events, lat, lng).orderBy(F.col("distance_km").asc_nulls_last(), "group_key")


def with_place(events: DataFrame) -> DataFrame:
    return events.withColumn("place", place_label(F.col("venue_name"), F.col("locality")))


def by_place(events: DataFrame) -> DataFrame:
    """Place headings together, blank ones last, case and accents ignored, then by start, then by group where there are groups."""
    last = [c for c in ("group_key",) if c in events.columns]
    return with_place(events).orderBy(F.col("place") == "", F.collate("place", "UNICODE_CI_AI"), "start_ts", *last)


def per_place(events: DataFrame) -> DataFrame:
    return with_place(events).groupBy("place").agg(
        F.count(F.lit(1)).alias("events"), F.min("start_ts").alias("first_start")
    )


def categories(events: DataFrame) -> DataFrame:
    return events.filter(F.col("category") != "").select("category").distinct().orderBy("category")


# --- places and links --------------------------------------------------------------------

NEAR_DEG = 0.0012


def events_at_venues(events: DataFrame, venues: DataFrame) -> DataFrame:
    """(group_key, area, cid) where the names agree or the positions almost coincide.

    Two joins on equal keys instead of one on a condition: lower-cased name,
    and position bins whose eight neighbours are listed on the venue side.
    """
    shown = events.filter(~F.col("hidden"))
    sites = venues.select("area", "cid", F.lower("name").alias("_name"), F.col("lat").alias("_vlat"),
                          F.col("lon").alias("_vlon"))
    named = shown.filter(F.col("venue_name") != "").select(
        "group_key", F.lower("venue_name").alias("_name")
    ).join(sites.select("area", "cid", "_name"), "_name").select("group_key", "area", "cid")
    around = F.sequence(F.lit(-1), F.lit(1))
    cell = lambda c: F.floor(c / NEAR_DEG)
    spread = (
        sites.withColumn("_dr", F.explode(around)).withColumn("_dc", F.explode(around))
        .withColumns({"_row": cell(F.col("_vlat")) + F.col("_dr"), "_col": cell(F.col("_vlon")) + F.col("_dc")})
    )
    placed = shown.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        "group_key", "lat", "lng", cell(F.col("lat")).alias("_row"), cell(F.col("lng")).alias("_col")
    )
    close = (F.abs(F.col("lat") - F.col("_vlat")) < NEAR_DEG) & (F.abs(F.col("lng") - F.col("_vlon")) < NEAR_DEG)
    near = placed.join(spread, ["_row", "_col"]).filter(close).select("group_key", "area", "cid")
    return named.unionByName(near).distinct()


def events_per_venue(events: DataFrame, venues: DataFrame) -> DataFrame:
    """(cid, events): how many events events_at_venues gives each; ``events`` has one row per group_key.

    Events of one name and position meet the same venues, and venues of one name and position the same events, so only
    one of each kind takes part and counts are added up behind the pairs.
    """
    kinds = events.filter(~F.col("hidden")).groupBy(F.lower("venue_name").alias("venue_name"), "lat", "lng").agg(F.count(F.lit(1)).alias("_n"))
    kinds = kinds.select(F.struct("venue_name", "lat", "lng", "_n").alias("group_key"), F.lit(False).alias("hidden"), "venue_name", "lat", "lng")
    members = venues.select("area", "cid", F.struct(F.lower("name").alias("name"), "lat", "lon").alias("_site")).distinct()
    sites = members.select("_site").distinct().select(
        F.lit("").alias("area"), F.col("_site").alias("cid"), "_site.name", "_site.lat", "_site.lon")
    pairs = events_at_venues(kinds, sites).select("group_key", F.col("cid").alias("_at"))
    one = Window.partitionBy("area", "cid")
    members = members.withColumn("_several", F.count(F.lit(1)).over(one) > 1)
    sums = pairs.groupBy("_at").agg(F.sum("group_key._n").alias("_n"))
    at = F.col("_site") == F.col("_at")
    single = members.filter(~F.col("_several")).join(sums, at).select("cid", "_n")
    # A venue listed under several names or positions meets an event once.
    several = members.filter("_several").join(pairs, at).select("area", "cid", "group_key").distinct().select("cid", "group_key._n")
    return single.unionByName(several).groupBy("cid").agg(F.sum("_n").alias("events"))


def event_links(heads: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct URLs per group: source links first, then those in the description.

    ``from_source`` marks links that are already a source of the group.
    """
    own = members.filter(F.col("url") != "").select("group_key", "url", F.lit(True).alias("s"), F.lit(0).alias("p"))
    told = heads.select("group_key", F.posexplode(urls_in(decode_entities(F.col("description")))).alias("p", "url"))
    both = own.unionByName(told.select("group_key", "url", F.lit(False).alias("s"), "p"))
    return both.groupBy("group_key", "url").agg(
        F.bool_or("s").alias("from_source"), F.min(F.when(~F.col("s"), F.col("p"))).alias("text_pos")
    ).withColumn("host", host_of(F.col("url")))


def social_profiles(links: DataFrame) -> DataFrame:
    """First link per (group, network, handle); source links come before the text's."""
    found = links.withColumn("_s", social_profile(F.col("url"))).filter(F.col("_s").isNotNull())
    order = F.struct(~F.col("from_source"), F.coalesce("text_pos", F.lit(0)), F.col("url"))
    return found.groupBy("group_key", F.col("_s.network").alias("network"), F.lower("_s.handle").alias("handle_key")).agg(
        F.min_by(F.struct(F.col("_s.handle").alias("handle"), F.col("url").alias("url")), order).alias("_f")
    ).select("group_key", "network", "_f.handle", "_f.url")


def bounds(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Smallest box around grid cells and visible located events."""
    corners = cells.select(F.col("south").alias("lat_lo"), F.col("north").alias("lat_hi"),
                           F.col("west").alias("lon_lo"), F.col("east").alias("lon_hi"))
    shown = events.filter(~F.col("hidden") & F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        F.col("lat").alias("lat_lo"), F.col("lat").alias("lat_hi"), F.col("lng").alias("lon_lo"),
        F.col("lng").alias("lon_hi"),
    )
    return corners.unionByName(shown).agg(
        F.min("lat_lo").alias("south"), F.min("lon_lo").alias("west"), F.max("lat_hi").alias("north"),
        F.max("lon_hi").alias("east"),
    )
