"""Sun, moon and forecast per location and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.astro import moon, sun_date, with_sun


def conditions(locations: DataFrame, forecast: DataFrame, as_of: Column, tz: str, n_days: int = 2) -> DataFrame:
    """One row per location (location, lat, lon) and day from today on; no forecast gives nulls.

    The n-th day takes the n-th forecast date of its location.
    """
    days = locations.withColumn("day_no", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1)))).withColumn(
        "at", as_of + F.make_dt_interval(days=F.col("day_no"))
    )
    lit = with_sun(days, "at", "lat", "lon", tz).withColumns({
        "moon": moon(F.col("at")), "date": F.date_format(sun_date(F.col("at"), tz), "yyyy-MM-dd"),
    })
    return lit.join(forecast, ["location", "date"], "left")
