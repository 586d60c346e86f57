"""Sources as functions from a landing frame to raw listings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.sources.ticketing import RAW_COLUMNS


@dataclass(frozen=True)
class Source:
    """A listing source: its name, its label and how its landing files become raw rows."""

    name: str
    label: str
    to_raw: Callable[[DataFrame], DataFrame]
    unofficial: bool = False


def gather(landings: dict[str, DataFrame], sources: list[Source], ingest_ts: Column) -> DataFrame:
    """Union of every source's raw rows over all areas, stamped with the ingest time."""
    frames = [s.to_raw(landings[s.name]).select(*RAW_COLUMNS) for s in sources if s.name in landings]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.withColumn("ingest_ts", ingest_ts)


def status_rollup(log: DataFrame, previous: DataFrame, as_of: Column) -> DataFrame:
    """Source status from an ingest log (source, area, outcome, reason, fetched) and the last status.

    outcome is ok, failed, disabled or missing. A source is in error only when
    every area failed; counts survive runs that produced none. ``as_of`` becomes
    the last fetch of every source in the log.
    """
    seen = log.groupBy("source").agg(
        F.bool_or(F.col("outcome") == "disabled").alias("_disabled"),
        F.bool_or(F.col("outcome") == "missing").alias("_missing"),
        F.count_if(F.col("outcome") == "failed").alias("_failed"), F.count(F.lit(1)).alias("_areas"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "ok", F.col("fetched"))), F.lit(0)).alias("_total"),
        # Distinct failure texts, one per kind of fault rather than per area.
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("outcome") == "failed", F.col("reason")))), "; ")
        .alias("_reasons"),
        F.max(F.when(F.col("outcome") == "missing", F.col("reason"))).alias("_needs"),
    )
    state = (
        F.when(F.col("_disabled"), "disabled").when(F.col("_missing"), "missing_config")
        .when(F.col("_failed") == F.col("_areas"), "error").otherwise("ok")
    )
    fetched = F.concat(
        F.lit("Fetched "), F.col("_total").cast("string"), F.lit(" events"),
        F.when(F.col("_areas") > 1, F.concat(F.lit(" across "), F.col("_areas").cast("string"), F.lit(" areas")))
        .otherwise(""),
        F.when(F.col("_failed") > 0, F.concat(F.lit(" ("), F.col("_failed").cast("string"), F.lit(" area failed)")))
        .otherwise(""),
    )
    message = F.when(F.col("_state") == "ok", fetched).when(F.col("_state") == "error", F.col("_reasons")).when(
        F.col("_state") == "missing_config", F.col("_needs")).otherwise("Disabled in Settings")
    now = seen.withColumn("_state", state).select(
        "source", F.col("_state").alias("new_state"), message.alias("new_message"),
        F.when(F.col("_state") == "ok", F.col("_total")).alias("new_count"), as_of.alias("new_fetch"),
    )
    return previous.join(now, "source", "full_outer").select(
        "source", F.coalesce("new_state", "state").alias("state"), F.coalesce("new_message", "message").alias("message"),
        F.coalesce("new_count", "count", F.lit(0)).alias("count"), F.coalesce("new_fetch", "last_fetch").alias("last_fetch"),
    )


def source_catalogue(catalogue: DataFrame, status: DataFrame) -> DataFrame:
    """Every known source with its status, 'never_run' when there is none."""
    return catalogue.join(status, "source", "left").select(
        "source", "label", "unofficial", F.coalesce("state", F.lit("never_run")).alias("state"),
        F.coalesce("message", F.lit("Not fetched yet")).alias("message"), F.coalesce("count", F.lit(0)).alias("count"), "last_fetch",
    )
