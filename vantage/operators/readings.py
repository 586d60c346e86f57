"""Venue readings: latest values, histories, light and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions.astro import computed_once, light_band, with_sun
from vantage.functions.shoot import best_window, is_dead, is_surge, profile_score, verdict
from vantage.functions.text import mentions
from vantage.functions.times import half_up, local_date, local_hour, local_weekday, weekday
from vantage.operators.validate import days, hours

READING_KEY = ["area", "name"]


def busyness(observations: DataFrame) -> DataFrame:
    """Named busyness readings (obs_id, area, name, ts, live, typical, weight). Expects parsed meta."""
    return observations.filter(
        (F.col("source") == vocab.BUSYNESS_SOURCE) & (F.coalesce(F.col("meta.name"), F.lit("")) != "")
    ).select("obs_id", "area", F.col("meta.name").alias("name"), "ts", F.col("meta.live").alias("live"),
             F.col("meta.typical").alias("typical"), "weight")


def latest_readings(readings: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Newest reading per venue, the first stored one on ties."""
    key = key or READING_KEY
    rest = [c for c in readings.columns if c not in key]
    return (
        readings.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col("ts"), -F.col("obs_id"))).alias("_r"))
        .select(*key, "_r.*")
    )


def venue_readings(venues: DataFrame, readings: DataFrame, as_of: Column, tz: str) -> DataFrame:
    """Every venue with its newest reading and a verdict under the light of that hour."""
    latest = latest_readings(readings).drop("obs_id")
    profile = F.col("profile")
    out = venues.join(latest, READING_KEY, "left").withColumn("_at", F.coalesce(F.col("ts"), as_of))
    out = with_sun(out, "_at", "lat", "lon", tz, "_sun")
    out = computed_once(out, _light=light_band(F.col("_sun"), local_hour(F.col("_at"), tz)))
    busy = F.coalesce("live", "typical")
    estimated = F.col("live").isNull() & F.col("typical").isNotNull()
    return out.select(
        "area", "cid", "name", "lat", "lon", "live", "typical", F.coalesce("weight", F.lit(0.0)).alias("score"),
        F.col("ts").alias("observed_at"), profile["busiest_day"].alias("busiest_day"),
        profile["busiest_hour"].alias("busiest_hour"), profile["quietest_day"].alias("quietest_day"),
        profile["open_days"].alias("open_days"),
        verdict(busy, F.col("typical"), F.col("_light"), estimated).alias("shoot"),
    )


# --- history -------------------------------------------------------------------------


def hourly_pattern(readings: DataFrame, tz: str) -> DataFrame:
    """Rounded mean and sample count of live readings per weekday and hour."""
    ts = F.col("ts")
    return (
        readings.filter(F.col("live").isNotNull())
        .groupBy(*READING_KEY, local_weekday(ts, tz).alias("dow"), local_hour(ts, tz).alias("hour"))
        .agg(half_up(F.avg("live")).cast("int").alias("avg_live"), F.count(F.lit(1)).alias("samples"))
    )


def trailing_baseline(readings: DataFrame, days_back: int = 28) -> DataFrame:
    """Each venue's live busyness by hour beside its own mean of the ``days_back`` days before that hour.

    (area, name, hour, live, samples, usual, usual_samples, surge, dead); ``hour`` counts hours of the epoch. Readings of one
    hour are one row; hours without readings leave no row and shorten the mean's base, not its span. Without any reading
    in the span ``usual`` is null and there is neither surge nor slump. Sums per hour are formed before the shuffle, so the
    window sorts hours of a venue, however many readings they hold.
    """
    hourly = (
        readings.filter(F.col("live").isNotNull() & F.col("ts").isNotNull())
        .groupBy(*READING_KEY, F.floor(F.unix_seconds("ts") / 3600).alias("hour"))
        .agg(F.sum("live").alias("_total"), F.count(F.lit(1)).alias("samples"))
    )
    before = Window.partitionBy(*READING_KEY).orderBy("hour").rangeBetween(-24 * days_back, -1)
    rows = hourly.withColumn("_before", F.sum("_total").over(before)).withColumn("usual_samples", F.coalesce(F.sum("samples").over(before), F.lit(0)))
    rows = rows.select(
        *READING_KEY, "hour", half_up(F.col("_total") / F.col("samples")).cast("int").alias("live"), "samples",
        half_up(F.col("_before") / F.nullif("usual_samples", F.lit(0))).cast("int").alias("usual"), "usual_samples")
    live, usual = F.col("live"), F.col("usual")
    return rows.withColumns({"surge": is_surge(live, usual), "dead": is_dead(live, usual)})


def daily_coverage(readings: DataFrame, venues: DataFrame, tz: str) -> DataFrame:
    """Readings and live readings per weekday, all seven weekdays present for every venue."""
    counted = readings.groupBy(*READING_KEY, local_weekday(F.col("ts"), tz).alias("dow")).agg(
        F.count(F.lit(1)).alias("readings"), F.count("live").alias("live")
    )
    week = venues.select("area", "cid", "name").distinct().withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return week.join(counted, [*READING_KEY, "dow"], "left").fillna(0, ["readings", "live"])


def _venue_week(venues: DataFrame, as_of: Column, tz: str, **carried: Column) -> DataFrame:
    """Each venue seven times, with the light of every hour on the next date of each weekday.

    ``carried`` columns may use dow; they travel along, so the weekly profile
    needs no join.
    """
    today = local_date(as_of, tz)
    step = F.col("_step")
    out = venues.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumns({
        "_at": as_of + F.make_dt_interval(days=step), "dow": weekday(F.date_add(today, step)),
    })
    keys = ["area", "cid", "name", "dow"]
    out = out.select(*keys, "lat", "lon", "_at", *[c.alias(n) for n, c in carried.items()])
    out = with_sun(out, "_at", "lat", "lon", tz, "_sun")
    lights = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: light_band(F.col("_sun"), h))
    return computed_once(out, light_by_hour=lights).select(*keys, "light_by_hour", *carried)


def week_light(venues: DataFrame, as_of: Column, tz: str) -> DataFrame:
    """(area, cid, name, dow, light_by_hour) for every venue and weekday."""
    return _venue_week(venues, as_of, tz)


def best_windows(venues: DataFrame, as_of: Column, tz: str) -> DataFrame:
    """Best shooting window per venue and weekday, from the weekly profile."""
    names = F.array(*[F.lit(d) for d in vocab.DAY_NAMES])
    curve = F.try_element_at(F.col("profile.by_day"), F.get(names, F.col("dow")))
    profiled = venues.filter(F.col("profile").isNotNull())
    joined = _venue_week(profiled, as_of, tz, _curve=curve).filter(F.size("_curve") > 0)
    bars = F.array_sort(F.map_entries("_curve"))
    joined = computed_once(joined, _bars=bars)
    scored = computed_once(joined, _scores=F.transform(
        "_bars", lambda e: profile_score(e["value"], F.get("light_by_hour", e["key"]))))
    hours_of = F.transform("_bars", lambda e: e["key"])
    best = computed_once(scored, best=best_window(hours_of, F.col("_scores")))
    return best.select("area", "cid", "name", "dow", "best")


def venue_history(venues: DataFrame, readings: DataFrame, as_of: Column, tz: str, n_days: int = 14) -> dict[str, DataFrame]:
    """Everything recorded for each venue over the last days, as keyed tables.

    points: readings; observed: live pattern; summary: weekday coverage with
    best window; light: band per hour; now: current verdict (null when stale).
    Readings know a venue by its name; venues of one name share them and stay apart by their cid.
    """
    recent = readings.filter(F.col("ts") >= as_of - days(n_days)).join(
        venues.select(*READING_KEY).distinct(), READING_KEY, "left_semi"
    )
    light = week_light(venues, as_of, tz)
    windows = best_windows(venues, as_of, tz).select("area", "cid", "dow", "best")
    summary = daily_coverage(recent, venues, tz).join(windows, ["area", "cid", "dow"], "left")
    newest = recent.groupBy(*READING_KEY).agg(
        F.max_by(F.struct("live", "typical"), F.struct("ts", "obs_id")).alias("_r"), F.max("ts").alias("ts")
    ).withColumn("dow", local_weekday(F.col("ts"), tz))
    now = newest.join(light, [*READING_KEY, "dow"], "left")
    live, typical = F.col("_r.live"), F.col("_r.typical")
    band = F.get("light_by_hour", local_hour(F.col("ts"), tz))
    fresh = as_of - F.col("ts") < hours(2)
    now = now.select("area", "cid", "name", "ts", F.when(
        fresh, verdict(F.coalesce(live, typical), typical, band, live.isNull())).alias("now"))
    return {
        "points": recent.select(*READING_KEY, "ts", "live", "typical"),
        "observed": hourly_pattern(recent, tz), "summary": summary, "light": light, "now": now,
    }


def recent_readings(readings: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` readings per venue; each map task forwards at most ``n`` rows a venue."""
    w = Window.partitionBy(*READING_KEY).orderBy(F.col("ts").desc(), F.col("obs_id").desc())
    return readings.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def area_summary(areas: DataFrame, venues: DataFrame) -> DataFrame:
    """Venue count and count with a weekly profile for every configured area."""
    counted = venues.groupBy(F.col("area").alias("slug")).agg(
        F.count(F.lit(1)).alias("venues"), F.count("profile").alias("with_profile")
    )
    return areas.select("slug", "name").join(counted, "slug", "left").fillna(0, ["venues", "with_profile"])


# --- orderings ---------------------------------------------------------------------


def busiest_first(readings: DataFrame) -> DataFrame:
    """Live readings, then typical ones, then unsampled; busiest first in each band, by area and cid at ties."""
    band = F.when(F.col("live").isNotNull(), 0).when(F.col("typical").isNotNull(), 1).otherwise(2)
    return readings.orderBy(band, F.coalesce("live", "typical", F.lit(0)).desc(), "area", "cid")


def by_score(readings: DataFrame) -> DataFrame:
    """Strongest reading first, by area and cid at ties."""
    return readings.orderBy(F.col("score").desc(), "area", "cid")


def best_to_shoot(readings: DataFrame) -> DataFrame:
    # Rounded, so that the last bits of equal scores do not decide.
    return readings.orderBy(F.round("shoot.score", 9).desc(), F.collate("name", "UNICODE"), "area", "cid")


def live_now(readings: DataFrame, n: int = 10) -> DataFrame:
    """Top live venues over all areas."""
    return readings.filter(F.col("live").isNotNull()).orderBy(F.col("live").desc(), "area", "name").limit(n)


def venue_named(readings: DataFrame, needle: str) -> DataFrame:
    return readings.filter(mentions(F.col("name"), needle))


