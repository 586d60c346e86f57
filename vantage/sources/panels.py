"""Busyness panel captures to readings and weekly profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions import let
from vantage.functions.times import local_hour

NOW_LABEL = r"(?i)Currently\s+(\d+)%\s+busy,\s+usually\s+(\d+)%\s+busy"
HOUR_LABEL = r"(?i)(\d+)%\s+busy\s+at\s+(\d+)\s*(am|pm)"


def busy_label(label: Column) -> Column:
    """struct(hour, pct) of a "64% busy at 7 am" label, null for anything else."""
    part = lambda i: F.regexp_extract(label, HOUR_LABEL, i)
    hour = part(2).try_cast("int") % 12 + F.when(F.lower(part(3)) == "pm", 12).otherwise(0)
    return F.when(part(1) != "", F.struct(hour.alias("hour"), part(1).try_cast("int").alias("pct")))


def parse_labels(labels: Column) -> tuple[Column, Column, Column]:
    """(live, typical_now, hourly curve) of one capture; the curve keeps the largest value per hour."""
    clean = F.filter(labels, lambda x: x.isNotNull())
    now = F.filter(clean, lambda x: x.rlike(NOW_LABEL))
    # A later "currently" label replaces an earlier one.
    last = F.try_element_at(now, F.lit(-1))
    live = F.regexp_extract(last, NOW_LABEL, 1).try_cast("int")
    typical = F.regexp_extract(last, NOW_LABEL, 2).try_cast("int")
    pairs = F.filter(
        F.transform(F.filter(clean, lambda x: ~x.rlike(NOW_LABEL)), busy_label), lambda p: p.isNotNull()
    )
    hours = F.array_distinct(F.transform(pairs, lambda p: p["hour"]))
    curve = F.transform(hours, lambda h: F.struct(
        h.alias("hour"),
        F.array_max(F.transform(F.filter(pairs, lambda p: p["hour"] == h), lambda p: p["pct"])).alias("pct"),
    ))
    return live, typical, F.map_from_entries(curve)


def week_profile(day_labels: Column) -> Column:
    """Weekly profile struct of seven label lists; null unless seven days and one of them open.

    Daily totals decide the busiest and quietest day, the earlier day on ties.
    """
    empty = F.array().cast("array<struct<hour:int,pct:int>>")
    week = F.transform(day_labels, lambda d: F.coalesce(
        F.filter(F.transform(d, busy_label), lambda p: p.isNotNull()), empty))
    total = lambda d: F.aggregate(d, F.lit(0), lambda a, p: a + p["pct"])
    names = F.array(*[F.lit(d) for d in vocab.DAY_NAMES])
    # A repeated hour keeps its last value, as in any keyed record.
    curve = lambda d: F.map_from_entries(F.filter(
        d, lambda p, j: ~F.exists(F.filter(d, lambda _q, k: k > j), lambda q: q["hour"] == p["hour"])))

    def summary(week: Column, ranked: Column, busiest: Column) -> Column:
        quietest = F.array_min(ranked)["i"]
        # First of the highest bars, in label order.
        peak = F.array_min(F.transform(
            F.get(week, busiest),
            lambda p, j: F.struct((-p["pct"]).alias("neg"), j.alias("j"), p["hour"].alias("hour")),
        ))
        return F.struct(
            F.get(names, busiest).alias("busiest_day"), busiest.alias("busiest_day_index"),
            peak["hour"].alias("busiest_hour"), (-peak["neg"]).alias("busiest_peak"),
            F.get(names, quietest).alias("quietest_day"),
            F.transform(ranked, lambda x: F.get(names, x["i"])).alias("open_days"),
            F.map_from_arrays(names, F.transform(week, curve)).alias("by_day"),
        )

    def profile(week: Column) -> Column:
        ranked = F.filter(
            F.transform(week, lambda d, i: F.struct(total(d).alias("t"), i.alias("i"))), lambda x: x["t"] > 0
        )
        busiest = lambda r: F.array_min(
            F.transform(r, lambda x: F.struct((-x["t"]).alias("t"), x["i"].alias("i"))))["i"]
        return let(ranked, lambda r: F.when(
            F.size(r) > 0, let(busiest(r), lambda top: summary(week, r, top))))

    return F.when(F.size(day_labels) == 7, let(week, profile))


def panel_readings(captures: DataFrame, venues: DataFrame, tz: str, weight: float = 1.0) -> DataFrame:
    """Observations of one pass of panel captures (area, cid, ts, labels, day_labels)."""
    live, typical_now, curve = parse_labels(F.col("labels"))
    parsed = captures.withColumns({
        "live": live, "_typical_now": typical_now, "_curve": curve, "_week": week_profile(F.col("day_labels")),
        "hour": local_hour(F.col("ts"), tz),
    })
    parsed = parsed.withColumn(
        "typical", F.coalesce(F.col("_typical_now"), F.try_element_at(F.col("_curve"), F.col("hour")))
    ).withColumn("pct", F.coalesce("live", "typical")).filter(F.col("pct").isNotNull())
    known = venues.select("area", "cid", "name", "lat", "lon", "profile")
    # A profile read in this capture wins over the stored one.
    seen = parsed.join(known, ["area", "cid"])
    meta = F.to_json(F.struct(
        "name", "live", "typical", "hour",
        F.coalesce("_week.busiest_day", "profile.busiest_day").alias("busiestDay"),
        F.coalesce("_week.busiest_hour", "profile.busiest_hour").alias("busiestHour"),
    ))
    return seen.select(
        "area", "cid", "ts", F.lit(vocab.BUSYNESS_SOURCE).alias("source"),
        F.when(F.col("live").isNotNull(), "live").otherwise("typical").alias("kind"),
        "lat", "lon", (F.col("pct") / 100.0 * weight).alias("weight"), meta.alias("meta"),
    )


def capture_quality(captures: DataFrame, waits: DataFrame | None, tz: str, short_ms: int = 3500) -> DataFrame:
    """Per area: venues, with live, with typical only, profiles read, quick-checked."""
    live, typical_now, curve = parse_labels(F.col("labels"))
    hour = local_hour(F.col("ts"), tz)
    rows = captures.select(
        "area", "cid", live.alias("live"),
        F.coalesce(typical_now, F.try_element_at(curve, hour)).alias("typical"),
        week_profile(F.col("day_labels")).isNotNull().alias("profiled"),
    )
    if waits is None:
        rows = rows.withColumn("wait_ms", F.lit(None).cast("int"))
    else:
        rows = rows.join(waits.select("area", "cid", "wait_ms"), ["area", "cid"], "left")
    return rows.groupBy("area").agg(
        F.count(F.lit(1)).alias("venues"), F.count("live").alias("with_live"),
        F.count_if(F.col("live").isNull() & F.col("typical").isNotNull()).alias("with_typical"),
        F.count_if("profiled").alias("profiles_updated"),
        F.count_if(F.col("wait_ms") == short_ms).alias("quick_checked"),
    )
