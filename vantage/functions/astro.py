"""Sun and moon as column math."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions.times import half_up, local, local_date

J2000 = 2451545.0
UNIX_EPOCH_JULIAN = 2440587.5
DAY_MS = 86400000.0
HORIZON_DEG, GOLDEN_DEG, BLUE_DEG = -0.833, 6.0, -6.0
SYNODIC_DAYS = 29.530588853
NEW_MOON_JULIAN = 2451550.26


def julian(ts: Column) -> Column:
    return F.unix_millis(ts) / DAY_MS + UNIX_EPOCH_JULIAN


def _solar(ts: Column, lon: Column) -> tuple[Column, Column]:
    """(transit as Julian date, declination in radians) of the day around ``ts``."""
    n = half_up(julian(ts) - J2000 - 0.0009 + lon / 360)
    noon = n + 0.0009 - lon / 360
    anomaly = (F.lit(357.5291) + noon * 0.98560028) % 360
    m = F.radians(anomaly)
    centre = F.sin(m) * 1.9148 + F.sin(m * 2) * 0.02 + F.sin(m * 3) * 0.0003
    lam = F.radians((anomaly + centre + 180 + 102.9372) % 360)
    transit = noon + J2000 + F.sin(m) * 0.0053 - F.sin(lam * 2) * 0.0069
    return transit, F.asin(F.sin(lam) * F.sin(F.radians(F.lit(23.44))))


def _crossing(lat: Column, declination: Column, elevation: float) -> Column:
    """Half the arc above ``elevation`` as a fraction of a day, null when never crossed."""
    cos_omega = (
        F.sin(F.radians(F.lit(elevation))) - F.sin(F.radians(lat)) * F.sin(declination)
    ) / (F.cos(F.radians(lat)) * F.cos(declination))
    return F.when(cos_omega.between(-1, 1), F.degrees(F.acos(cos_omega)) / 360)


def _instant(julian_date: Column) -> Column:
    ms = ((julian_date - UNIX_EPOCH_JULIAN) * DAY_MS).cast("bigint")
    return F.timestamp_millis(ms)


def computed_once(df, **columns: Column):
    """Add columns through a one-row generator.

    Projections above it see plain attributes, so the optimizer cannot copy
    these expressions into lambdas or filters that use them many times.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_sun(df, ts: str, lat: str, lon: str, tz: str, name: str = "sun"):
    """Add a struct of sun times for the day around ``ts``; fields are null when undefined.

    ``clock`` holds the same times as fractional local hours. Intermediate
    columns are separate projections, so each step is computed once.
    """
    transit, declination = _solar(F.col(ts), F.col(lon))
    out = df.withColumns({"_transit": transit, "_declination": declination})
    out = out.withColumns({
        f"_arc_{key}": _crossing(F.col(lat), F.col("_declination"), deg)
        for key, deg in (("horizon", HORIZON_DEG), ("golden", GOLDEN_DEG), ("blue", BLUE_DEG))
    })
    at = lambda key, sign: _instant(F.col("_transit") + F.col(f"_arc_{key}") * sign)
    times = {
        "rise": at("horizon", -1), "set": at("horizon", 1), "gold_rise": at("golden", -1),
        "gold_set": at("golden", 1), "blue_rise": at("blue", -1), "blue_set": at("blue", 1),
    }
    out = out.withColumns({f"_{key}": c for key, c in times.items()})
    minutes = half_up((F.unix_millis("_set") - F.unix_millis("_rise")) / 60000.0)
    day_length = F.concat(
        F.floor(minutes / 60).cast("string"), F.lit("h "), F.lpad((minutes % 60).cast("string"), 2, "0"),
        F.lit("m"),
    )
    span = lambda a, b: F.when(
        F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    )
    clock = lambda c: F.hour(local(c, tz)) + F.minute(local(c, tz)) / 60.0
    sun = F.struct(
        F.col("_rise").alias("sunrise"), F.col("_set").alias("sunset"),
        F.when(F.col("_rise").isNotNull(), _instant(F.col("_transit"))).alias("solar_noon"),
        day_length.alias("day_length"),
        span("_rise", "_gold_rise").alias("golden_morning"),
        span("_gold_set", "_set").alias("golden_evening"),
        span("_blue_rise", "_rise").alias("blue_morning"),
        span("_set", "_blue_set").alias("blue_evening"),
        F.struct(*[clock(F.col(f"_{key}")).alias(key) for key in times]).alias("clock"),
    )
    return computed_once(out, **{name: sun}).select(*[c for c in df.columns if c != name], name)


def moon(ts: Column) -> Column:
    """struct(age, phase, illumination) from the mean synodic month."""
    age = F.pmod(julian(ts) - NEW_MOON_JULIAN, F.lit(SYNODIC_DAYS))
    fraction = age / SYNODIC_DAYS
    lit_share = half_up((F.lit(1.0) - F.cos(fraction * 6.283185307179586)) / 2 * 100)
    phase = F.lit(vocab.MOON_PHASES[0][1])
    for upper, label in reversed(vocab.MOON_PHASES[1:]):
        below = fraction <= upper if label == vocab.MOON_PHASES[-1][1] else fraction < upper
        phase = F.when(below, label).otherwise(phase)
    phase = F.when(fraction < vocab.MOON_PHASES[0][0], vocab.MOON_PHASES[0][1]).otherwise(phase)
    return F.struct(
        (half_up(age * 10) / 10.0).alias("age"), phase.alias("phase"),
        lit_share.cast("int").alias("illumination"),
    )


def light_band(sun: Column, hour: Column) -> Column:
    """golden, blue, day or night at the middle of a local hour."""
    t, clock = hour + 0.5, sun["clock"]
    inside = lambda a, b: F.coalesce(t.between(clock[a], clock[b]), F.lit(False))
    return (
        F.when(inside("rise", "gold_rise") | inside("gold_set", "set"), "golden")
        .when(inside("blue_rise", "rise") | inside("set", "blue_set"), "blue")
        .when(clock["rise"].isNull() | inside("rise", "set"), "day")
        .otherwise("night")
    )


def sun_date(ts: Column, tz: str) -> Column:
    """The date that labels a sun day: the local calendar date."""
    return local_date(ts, tz)
