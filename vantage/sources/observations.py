"""Density observations: scan, append, roll-ups of a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions.times import local_hour, local_weekday

META_SCHEMA = (
    "name string, live int, typical int, hour int, busiestDay string, busiestHour int, "
    "street string, city string, speedKmh double, delaySec int, lengthM bigint, "
    "type string, subtype string, description string, reportedAt string, reliability double, thumbsUp int"
)


def parse_meta(observations: DataFrame) -> DataFrame:
    """Turn the JSON text in ``meta`` into a struct; unreadable text gives null fields."""
    return observations.withColumn("meta", F.from_json("meta", META_SCHEMA))


def scan_observations(
    source: DataFrame, area: str | None = None, since: Column | None = None, sources: list[str] | None = None,
    hour_of_day: int | None = None, days_of_week: list[int] | None = None, tz: str = "UTC",
) -> DataFrame:
    """Observations under the optional predicates; area and time prune partitions and row groups."""
    out = source
    if area:
        out = out.filter(F.col("area") == area)
    if since is not None:
        out = out.filter(F.col("ts") >= since)
        if "obs_date" in source.columns:
            out = out.filter(F.col("obs_date") >= F.to_date(since))
    if sources:
        out = out.filter(F.col("source").isin(sources))
    if hour_of_day is not None:
        out = out.filter(local_hour(F.col("ts"), tz) == hour_of_day)
    if days_of_week:
        out = out.filter(local_weekday(F.col("ts"), tz).isin(days_of_week))
    return out


def append_pass(observations: DataFrame, run: DataFrame, root: str) -> None:
    """Append one pass: its run row and its observations, laid out by area and day."""
    (
        observations.withColumn("obs_date", F.to_date("ts"))
        .repartitionByRange("area", "obs_date", "ts")
        .sortWithinPartitions("area", "obs_date", "source", "ts")
        .write.mode("append").partitionBy("area", "obs_date").parquet(f"{root}/density_observation")
    )
    run.write.mode("append").parquet(f"{root}/density_run")


def read_observations(spark: SparkSession, root: str) -> DataFrame:
    """The appended observations; the areas of the folder names are texts, whatever they look like."""
    path = f"{root}/density_observation"
    found = spark.read.parquet(path).schema
    kinds = {"area": "string", "obs_date": "date"}
    columns = [f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in found]
    return spark.read.schema(", ".join(columns)).parquet(path)


def per_pass_source(observations: DataFrame) -> DataFrame:
    """Observations per source in every pass."""
    return observations.groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("observations"))


def last_run(runs: DataFrame) -> DataFrame:
    """Newest run per area."""
    return runs.groupBy("area").agg(
        F.max_by(F.struct("run_id", "summary"), F.struct("ts", "run_id")).alias("_r"), F.max("ts").alias("ts")
    ).select("area", "ts", "_r.run_id", "_r.summary")


def snapshots(observations: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("ts") if approximate else F.count_distinct("ts")
    return observations.groupBy("area").agg(count.alias("snapshots"))
