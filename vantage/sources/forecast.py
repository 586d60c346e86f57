"""Daily forecast responses to one row per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage import vocab

FORECAST_SCHEMA = """
location string,
current struct<temperature_2m:double,cloud_cover:double,weather_code:int,wind_speed_10m:double>,
daily struct<time:array<string>,weather_code:array<int>,temperature_2m_max:array<double>,
  temperature_2m_min:array<double>,precipitation_probability_max:array<double>,uv_index_max:array<double>,
  wind_speed_10m_max:array<double>,cloud_cover_mean:array<double>>
"""


def weather_text(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.WEATHER_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("Unknown"))


def daily_forecast(responses: DataFrame) -> DataFrame:
    """(location, date, summary, temp_max, ...) from parallel arrays; shorter arrays give nulls."""
    d = "daily."
    days = responses.select("location", F.posexplode(d + "time").alias("i", "date"), "daily")
    at = lambda name: F.get(F.col(d + name), F.col("i"))
    return days.select(
        "location", "date", weather_text(at("weather_code")).alias("summary"),
        at("temperature_2m_max").alias("temp_max"), at("temperature_2m_min").alias("temp_min"),
        at("cloud_cover_mean").alias("cloud_cover"), at("precipitation_probability_max").alias("rain_chance"),
        at("uv_index_max").alias("uv_max"), at("wind_speed_10m_max").alias("wind_max"),
    )


def current_weather(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col("current").isNotNull()).select(
        "location", F.col("current.temperature_2m").alias("temp"), F.col("current.cloud_cover").alias("cloud_cover"),
        weather_text(F.col("current.weather_code")).alias("summary"), F.col("current.wind_speed_10m").alias("wind"),
    )
