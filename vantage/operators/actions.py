"""People's decisions on groups: stars, hiding, merging and splitting.

Each function returns (id, ...) rows for an action table keyed by listing id,
which apply_actions folds into the event table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.operators.merged import group_rows
from vantage.session import checkpointed


def set_flag(events: DataFrame, groups: DataFrame, flag: str, value: bool) -> DataFrame:
    """Mark every listing behind the given groups; flag is 'starred' or 'hidden'."""
    if flag not in ("starred", "hidden"):
        raise ValueError(flag)
    return group_rows(events, groups).select("id", F.lit(value).alias(flag))


# Listings whose ids share all but these low bits are named together.
SLICE_BITS = 16


def merge_groups(events: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, manual_group) for merge requests (request_id, group_key).

    The new group name depends on the member ids alone, so repeating a merge
    changes nothing. Requests that name fewer than two listings are dropped;
    see refused_merges. Ids are digested in slices of at most 65,536, and the
    name is a digest of the ordered slice digests, so no id list grows with the
    group.
    """
    requests, rows = _stored(events, requests)
    asked = _asked(rows, requests, F.sum("_n") >= 2)
    # A listing named by several requests follows the last one, so a group's last request is the only one that can name it.
    last = asked.groupBy("group_key").agg(F.max("request_id").alias("request_id"))
    needed = asked.join(last.select("request_id").distinct(), "request_id", "left_semi")
    sliced = rows.withColumn("_slice", F.shiftright("id", SLICE_BITS))
    # Requests that have the same groups in a slice share its digest: each such set is read and digested once.
    present = needed.join(sliced.select("group_key", "_slice").distinct(), "group_key")
    sets = checkpointed(present.groupBy("request_id", "_slice").agg(F.array_sort(F.collect_set("group_key")).alias("_set")))
    once = sets.select(F.col("_slice").alias("_at"), F.col("_set").alias("_groups")).distinct()
    digests = once.withColumn("group_key", F.explode("_groups")).join(
        sliced.withColumnRenamed("group_key", "_key"), (F.col("group_key") == F.col("_key")) & F.col("_at").eqNullSafe(F.col("_slice"))
    ).groupBy("_at", "_groups").agg(
        F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")).alias("_part"))
    slices = sets.join(digests, F.col("_slice").eqNullSafe(F.col("_at")) & (F.col("_set") == F.col("_groups")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_slice", "_part"))), lambda x: x["_part"])
    named = slices.groupBy("request_id").agg(
        F.concat(F.lit("m"), F.substring(F.sha1(F.array_join(parts, ",")), 1, 15)).alias("manual_group"))
    return rows.join(last, "group_key").groupBy("id").agg(F.max("request_id").alias("request_id")).join(
        named, "request_id").select("id", "manual_group")


def refused_merges(events: DataFrame, requests: DataFrame) -> DataFrame:
    requests, rows = _stored(events, requests)
    enough = _asked(rows, requests, F.min("_min") < F.max("_max")).select("request_id").distinct()
    return requests.select("request_id").distinct().join(enough, "request_id", "left_anti").select(
        "request_id", F.lit("Merging needs at least two distinct events").alias("error"))


def _stored(events: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct requests, (id, group_key) of the listings behind them): used several times, so events are read once for each."""
    requests = checkpointed(requests.select("request_id", "group_key").distinct())
    return requests, checkpointed(group_rows(events, requests).select("id", "group_key"))


def _asked(rows: DataFrame, requests: DataFrame, enough: Column) -> DataFrame:
    """Distinct (request_id, group_key) of the requests that are large enough.

    The size and the smallest and largest id of every group tell, so no request is multiplied by its listings.
    """
    ends = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_min"), F.max("id").alias("_max"))
    large = requests.join(ends, "group_key").groupBy("request_id").agg(enough.alias("_ok")).filter("_ok").select("request_id")
    return requests.join(large, "request_id", "left_semi")


def unmerge_groups(events: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, manual_group = '') for every listing in the given manual groups."""
    wanted = groups.select(F.col("group_key").alias("manual_group")).filter(F.col("manual_group") != "").distinct()
    return events.join(wanted, "manual_group", "left_semi").select("id", F.lit("").alias("manual_group"))


def apply_actions(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Overwrite the columns an action table carries, for the ids it lists."""
    fields = [c for c in actions.columns if c != "id"]
    renamed = actions.select("id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    return events.join(renamed, "id", "left").withColumns(
        {c: F.coalesce(f"_new_{c}", c) for c in fields}
    ).select(*events.columns)
