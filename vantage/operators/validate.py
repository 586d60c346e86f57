"""Checks and repairs on incoming and stored listings."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.geo import haversine_km
from vantage.functions.times import half_up, parse_time

PAST_GRACE_HOURS = 36
HORIZON_DAYS = 400
MAX_DURATION_DAYS = 21
RADIUS_SLACK = 1.5


@dataclass(frozen=True)
class Area:
    """A place to search, as configured for the job."""

    name: str
    lat: float
    lng: float
    radius_km: float


def hours(n: float) -> Column:
    return F.make_dt_interval(hours=F.lit(n)) if isinstance(n, int) else F.make_dt_interval(
        secs=F.lit(n * 3600.0)
    )


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def plausible_end(start: Column, end: Column) -> Column:
    """The end if it follows the start by at most the longest believable run, else null."""
    return F.when((end > start) & (end <= start + days(MAX_DURATION_DAYS)), end)


def check_dates(raw: DataFrame, as_of: Column) -> DataFrame:
    """Parse the text times; add start_ts, end_ts and a reason ('' when the row is fine)."""
    parsed = raw.withColumns({"start_ts": parse_time(F.col("start_time")), "_end": parse_time(F.col("end_time"))})
    start = F.col("start_ts")
    day = F.date_format(start, "yyyy-MM-dd")
    reason = (
        F.when(start.isNull(), "no parsable start time")
        .when(start < as_of - hours(PAST_GRACE_HOURS), F.concat(F.lit("start "), day, F.lit(" is in the past")))
        .when(start > as_of + days(HORIZON_DAYS), F.concat(F.lit("start "), day, F.lit(" is beyond the horizon")))
        .otherwise("")
    )
    return parsed.withColumns({
        "date_reason": reason, "end_ts": plausible_end(start, F.col("_end")),
    }).drop("_end")


def area_list(areas: list[Area]) -> Column:
    """The areas of a job as one constant array; its size is that of the job's settings."""
    text = json.dumps([{"lat": a.lat, "lng": a.lng, "radius_km": a.radius_km} for a in areas])
    return F.from_json(F.lit(text), "array<struct<lat:double,lng:double,radius_km:double>>")


def nearest_area_km(lat: Column, lng: Column, areas: list[Area]) -> Column:
    """Distance to the nearest area's centre, null without areas."""
    return F.array_min(F.transform(area_list(areas), lambda a: haversine_km(a["lat"], a["lng"], lat, lng)))


def inside_any_area(lat: Column, lng: Column, areas: list[Area], slack: float = RADIUS_SLACK) -> Column:
    return F.coalesce(F.exists(
        area_list(areas), lambda a: haversine_km(a["lat"], a["lng"], lat, lng) <= a["radius_km"] * slack
    ), F.lit(False))


def check_location(raw: DataFrame, areas: list[Area]) -> DataFrame:
    """Add place_reason: '' for rows without coordinates or near an area; without areas no place is near."""
    lat, lng = F.col("lat"), F.col("lng")
    km = half_up(nearest_area_km(lat, lng, areas)).cast("string")
    fine = lat.isNull() | lng.isNull() | inside_any_area(lat, lng, areas)
    return raw.withColumn(
        "place_reason", F.when(fine, "").otherwise(F.concat_ws(" km ", km, F.lit("outside every area")))
    )


def areas_within(points: DataFrame, areas: DataFrame, id_col: str, slack: float = RADIUS_SLACK,
                 bin_deg: float = 0.5) -> DataFrame:
    """(id, area name) for every area whose slackened radius covers a point.

    For area tables of any size: both sides meet on a latitude/longitude bin,
    so there is no all-against-all comparison. Longitudes wrap at 180 degrees;
    near the poles an area covers every longitude bin.
    """
    n_lon = int(round(360 / bin_deg))
    reach_lat = F.col("radius_km") * slack / 110.0
    cos_lat = F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("lat")) + reach_lat)))
    reach_lon = F.when(cos_lat > 0.01, F.least(F.lit(180.0), reach_lat / cos_lat)).otherwise(180.0)
    lat_bins = F.sequence(
        F.floor((F.col("lat") - reach_lat) / bin_deg), F.floor((F.col("lat") + reach_lat) / bin_deg)
    )
    lon_bins = F.array_distinct(F.transform(
        F.sequence(F.floor((F.col("lng") - reach_lon) / bin_deg), F.floor((F.col("lng") + reach_lon) / bin_deg)),
        lambda b: F.pmod(b, F.lit(n_lon)),
    ))
    covered = (
        areas.select(F.col("name").alias("area"), F.col("lat").alias("_alat"), F.col("lng").alias("_alng"),
                     F.col("radius_km").alias("_radius"), lat_bins.alias("_lat_bins"), lon_bins.alias("_lon_bins"))
        .withColumn("_lat_bin", F.explode("_lat_bins")).withColumn("_lon_bin", F.explode("_lon_bins"))
        .drop("_lat_bins", "_lon_bins")
    )
    placed = points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        id_col, "lat", "lng",
        F.floor(F.col("lat") / bin_deg).alias("_lat_bin"),
        F.pmod(F.floor(F.col("lng") / bin_deg), F.lit(n_lon)).alias("_lon_bin"),
    )
    near = haversine_km(F.col("_alat"), F.col("_alng"), F.col("lat"), F.col("lng")) <= F.col("_radius") * slack
    return placed.join(covered, ["_lat_bin", "_lon_bin"]).filter(near).select(id_col, "area")


def points_per_area(points: DataFrame, areas: DataFrame, slack: float = RADIUS_SLACK, bin_deg: float = 0.5) -> DataFrame:
    """(area, n): how many points areas_within gives each area name that has any.

    Points at one position lie in the same circles, and equal circles hold the same points, so only one of each takes
    part and counts are added up behind the pairs.
    """
    spots = points.groupBy("lat", "lng").agg(F.count(F.lit(1)).alias("_n")).select(F.struct("lat", "lng", "_n").alias("_spot"), "lat", "lng")
    named = areas.select(F.col("name").alias("area"), F.struct("lat", "lng", "radius_km").alias("_circle"))
    circles = named.select("_circle").distinct().select(F.col("_circle").alias("name"), "_circle.*")
    sums = areas_within(spots, circles, "_spot", slack, bin_deg).groupBy(F.col("area").alias("_at")).agg(F.sum("_spot._n").alias("_n"))
    return named.join(sums, F.col("_circle") == F.col("_at")).groupBy("area").agg(F.sum("_n").alias("n"))


def split_valid(raw: DataFrame, as_of: Column, areas: list[Area]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with a reason)."""
    checked = check_location(check_dates(raw, as_of), areas)
    reason = F.when(F.col("date_reason") != "", F.col("date_reason")).otherwise(F.col("place_reason"))
    checked = checked.withColumn("reason", reason).drop("date_reason", "place_reason")
    return checked.filter(F.col("reason") == "").drop("reason"), checked.filter(F.col("reason") != "")


def dropped_by_reason(rejected: DataFrame) -> DataFrame:
    """Rejection counts per source and kind of reason."""
    kind = (
        F.when(F.col("reason").endswith("in the past"), "past")
        .when(F.col("reason").endswith("beyond the horizon"), "horizon")
        .when(F.col("reason").endswith("outside every area"), "outside")
        .otherwise("no start")
    )
    return rejected.groupBy("source", kind.alias("reason_kind")).agg(F.count(F.lit(1)).alias("dropped"))


def repair_dates(events: DataFrame) -> DataFrame:
    return events.withColumn("end_ts", plausible_end(F.col("start_ts"), F.col("end_ts")))


# --- archive ---------------------------------------------------------------------


def archive_past(events: DataFrame, as_of: Column) -> DataFrame:
    """Flag rows that ended (or started) more than a day ago and stamp when."""
    over = ~F.col("archived") & (F.coalesce("end_ts", "start_ts") < as_of - hours(24))
    return events.withColumns({
        "archived_at": F.when(over, as_of).otherwise(F.col("archived_at")),
        "archived": F.col("archived") | over,
    })


def purge_archived(events: DataFrame, as_of: Column, keep_days: int = 730) -> DataFrame:
    old = F.coalesce("end_ts", "start_ts") < as_of - days(keep_days)
    return events.filter(~(F.col("archived") & ~F.col("starred") & old))
