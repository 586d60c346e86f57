"""Streaming forms of the batch operators.

Every job takes a streaming DataFrame and returns a started query. The default
trigger drains what has landed and stops, which suits a scheduled pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from vantage.functions.times import half_up
from vantage.operators.event_store import BUCKETS, upsert_batch
from vantage.operators.merge import read_current, write_next
from vantage.operators.validate import Area, split_valid
from vantage.session import checkpointed

DRAIN = {"availableNow": True}


def read_landing(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def append_observations(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append landed observations to the table laid out by area and day."""
    return (
        stream.withColumn("obs_date", F.to_date("ts")).writeStream.format("parquet").outputMode("append")
        .partitionBy("area", "obs_date").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN)).start(path)
    )


def unique_sightings(stream: DataFrame, key: list[str], delay: str = "2 hours") -> DataFrame:
    """One row per key within a pass. Rows of one key must carry the same content."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def latest_per_venue(stream: DataFrame) -> DataFrame:
    """Newest reading per venue; write with the update mode."""
    return stream.groupBy("area", "name").agg(
        F.max_by(F.struct("live", "typical", "weight"), F.struct(F.col("ts"), -F.col("obs_id"))).alias("_r"),
        F.max("ts").alias("ts"),
    ).select("area", "name", "ts", "_r.live", "_r.typical", "_r.weight")


def quarter_sums(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Live readings summed per venue and quarter of an hour, which no zone's offset splits.

    Complete quarters come out once the watermark passes.
    """
    return (
        stream.filter(F.col("live").isNotNull()).withWatermark("ts", delay)
        .groupBy("area", "name", F.window("ts", "15 minutes"))
        .agg(F.sum("live").alias("live_sum"), F.count(F.lit(1)).alias("samples"))
        .select("area", "name", F.col("window.start").alias("start"), "live_sum", "samples")
    )


def fold_hours(quarters: DataFrame, tz: str) -> DataFrame:
    """Sums of quarters to the weekday and hour pattern of a zone."""
    start = F.from_utc_timestamp("start", tz)
    return quarters.groupBy("area", "name", (F.dayofweek(start) - 1).alias("dow"), F.hour(start).alias("hour")).agg(
        half_up(F.sum("live_sum") / F.sum("samples")).cast("int").alias("avg_live"), F.sum("samples").alias("samples")
    )


class Streaks(StatefulProcessor):
    """Checks without a panel since the newest check with one, per venue, for checks that come in any order and more than once.

    A check behind the watermark can't come any more, and every hit still to come ends the streak of all misses behind it. So
    misses behind the watermark are kept as one number, and only those ahead of it by their time and id: the state of a venue
    is as large as the lateness allowed, however long its streak.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hit = handle.getValueState("hit", "at long, check_id long")
        self.settled = handle.getValueState("settled", "misses long")
        self.open = handle.getMapState("open", "at long, check_id long", "miss boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timer_values.getCurrentWatermarkInMs() * 1000
        hit = tuple(self.hit.get()) if self.hit.exists() else None
        settled = self.settled.get()[0] if self.settled.exists() else 0
        for batch in rows:
            at = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            for t, check, saw in zip(at.tolist(), batch["check_id"].tolist(), batch["saw_panel"].tolist()):
                if t < mark:
                    continue
                if not saw:
                    self.open.updateValue((t, check), (True,))
                elif hit is None or (t, check) > hit:
                    hit, settled = (t, check), 0
                    self.hit.update(hit)
        recent = 0
        for place in [tuple(p) for p in self.open.keys()]:
            if hit is not None and place <= hit:
                self.open.removeKey(place)
            elif place[0] < mark:
                self.open.removeKey(place)
                settled += 1
            else:
                recent += 1
        self.settled.update((settled,))
        yield pd.DataFrame({"area": [key[0]], "cid": [key[1]], "barren_streak": [settled + recent]})

    def close(self) -> None:
        pass


def barren_streaks(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Running count of checks (area, cid, ts, check_id, saw_panel) without a panel since the newest with one; write with the update mode.

    Checks that are more than ``lateness`` behind the newest one seen are left out.
    """
    return stream.withWatermark("ts", lateness).groupBy("area", "cid").transformWithStateInPandas(
        Streaks(), "area string, cid string, barren_streak long", "Update", "EventTime")


def upsert_stream(
    stream: DataFrame, table: str, checkpoint: str, order: list[str], trigger: dict | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Merge every micro-batch into the bucketed event table."""
    return (
        stream.writeStream.foreachBatch(lambda batch, epoch: upsert_batch(batch, epoch, table, order, buckets) and None)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or DRAIN)).start()
    )


def validate_stream(
    stream: DataFrame, accepted: str, rejected: str, checkpoint: str, areas: list[Area],
    event_time: str | None = None, as_of: Column | Callable[[], Column] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Split landed listings into accepted rows and rejects with their reason.

    With ``event_time`` the clock of a batch is a watermark: the newest such
    time in this and all earlier batches, kept beside the rejects. Listings
    that start more than the grace of the date check behind it go to the
    rejects. Else ``as_of`` is the clock; a function is asked anew for every
    batch. Folders are named by batch, so a replayed batch overwrites itself
    and finds the same watermark.
    """
    marks = f"{rejected}-watermark"

    def clock(batch: DataFrame, epoch: int) -> Column:
        if event_time is None:
            return as_of() if callable(as_of) else as_of
        spark = batch.sparkSession
        seen = batch.agg(F.max(event_time).alias("mark"))
        if epoch:
            seen = spark.read.schema("mark timestamp").parquet(f"{marks}/batch={epoch - 1}").unionByName(seen).agg(F.max("mark").alias("mark"))
        mark = checkpointed(seen)
        mark.write.mode("overwrite").parquet(f"{marks}/batch={epoch}")
        # A batch whose times are all missing before any was seen has no watermark: nothing is late.
        return F.lit(mark.first()[0]).cast("timestamp")

    def split(batch: DataFrame, epoch: int) -> None:
        good, bad = split_valid(batch, clock(batch, epoch), areas)
        good.write.mode("overwrite").parquet(f"{accepted}/batch={epoch}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={epoch}")

    return (
        stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN)).start()
    )


def snapshot_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, max_age: Column | None = None) -> StreamingQuery:
    """Keep only the newest pass of each area; a batch with an older pass changes nothing.

    With ``max_age`` (an interval) an area whose newest pass is older than that is left out.
    """

    def refresh(batch: DataFrame, _epoch: int) -> None:
        current = read_current(batch.sparkSession, path)
        both = batch if current is None else current.select(*batch.columns).unionByName(batch)
        newest = both.join(both.groupBy("area").agg(F.max("ts").alias("ts")), ["area", "ts"]).select(*batch.columns)
        if max_age is not None:
            newest = newest.filter(F.col("ts") >= F.current_timestamp() - max_age)
        # A pass split over two batches, or a replayed batch, must not repeat rows.
        write_next(newest.dropDuplicates(["area", "obs_id"]), path)

    return (
        stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DRAIN)).start()
    )
