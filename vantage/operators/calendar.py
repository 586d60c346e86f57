"""Calendar views over merged events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.times import local_date, weekday
from vantage.operators.validate import hours


def visible(events: DataFrame, category: str = "", starred_only: bool = False) -> DataFrame:
    out = events.filter(~F.col("hidden"))
    if category:
        out = out.filter(F.col("category") == category)
    return out.filter("starred") if starred_only else out


def per_day(events: DataFrame, tz: str) -> DataFrame:
    return events.groupBy(local_date(F.col("start_ts"), tz).alias("day")).agg(F.count(F.lit(1)).alias("events"))


def agenda(events: DataFrame, as_of: Column, tz: str) -> DataFrame:
    """Events not over an hour ago with their local day, in order."""
    return events.filter(F.col("start_ts") >= as_of - hours(1)).withColumn(
        "day", local_date(F.col("start_ts"), tz)
    ).orderBy("day", "start_ts")


def _days(events: DataFrame, first: Column, n: int) -> DataFrame:
    span = F.sequence(first, F.date_add(first, n - 1))
    return events.sparkSession.range(1).select(F.explode(span).alias("day"))


def month_grid(events: DataFrame, month: date, tz: str, shown: int = 3) -> DataFrame:
    """The 42 days of a month view: count, overflow and the first few titles of each."""
    first = F.lit(month.replace(day=1))
    start = F.date_sub(first, weekday(first))
    return _day_cells(events, start, 42, tz, shown)


def week_grid(events: DataFrame, day: date, tz: str, shown: int = 3) -> DataFrame:
    start = F.date_sub(F.lit(day), weekday(F.lit(day)))
    return _day_cells(events, start, 7, tz, shown)


def _day_cells(events: DataFrame, start: Column, n: int, tz: str, shown: int) -> DataFrame:
    dated = events.withColumn("day", local_date(F.col("start_ts"), tz)).filter(
        F.col("day").between(start, F.date_add(start, n - 1))
    )
    counts = dated.groupBy("day").agg(F.count(F.lit(1)).alias("events"))
    order = Window.partitionBy("day").orderBy("start_ts", "group_key")
    # At most ``shown`` rows a day leave each map task, and a day's list is that short.
    top = dated.select("day", "start_ts", "group_key", "title").withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= shown
    ).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("_n", "title"))).alias("_top"))
    return (
        _days(events, start, n).join(counts, "day", "left").join(top, "day", "left")
        .select("day", F.coalesce("events", F.lit(0)).alias("events"),
                F.greatest(F.lit(0), F.coalesce("events", F.lit(0)) - shown).alias("more"),
                F.transform("_top", lambda t: t["title"]).alias("titles"))
    )
