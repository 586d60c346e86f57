"""Exact ranks that never sort one key's rows in a single task.

A plain window over a key that holds a third of all rows sends them to one
task. Here rows are counted per (key, bucket) first; only the short bucket
table is accumulated per key, and full ordering happens inside one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.session import checkpointed


def rank_by_id(df: DataFrame, keys: list[str], id_col: str, name: str, shift: int = 20) -> DataFrame:
    """Zero-based position of each distinct id within its key, ascending.

    ``id_col`` is a non-negative whole number, unique within the key. A bucket
    spans 2**shift ids, which bounds the rows any one sort sees.
    """
    bucketed = df.withColumn("_bucket", F.shiftright(F.col(id_col).cast("bigint"), shift))
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(id_col)
    return (
        bucketed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_bucket", "_before", "_row")
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str, index: Column, name: str) -> DataFrame:
    """Per key the value at zero-based position ``index`` of the sorted positive values.

    ``index`` is an expression over the column ``n`` (count of values). Buckets
    are fractions of a power of two; equal values collapse into one counted row.
    """
    steps = 64
    bucketed = df.filter(F.col(value) > 0).withColumn(
        "_bucket", F.floor(F.log2(F.col(value)) * steps)
    )
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    running = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    target = (
        sizes.withColumn("_upto", F.sum("_size").over(running))
        .withColumn("n", F.sum("_size").over(Window.partitionBy(*keys)))
        .withColumn("_index", index)
        .filter((F.col("_upto") > F.col("_index")) & (F.col("_upto") - F.col("_size") <= F.col("_index")))
        .select(*keys, "_bucket", "n", (F.col("_index") - F.col("_upto") + F.col("_size")).alias("_offset"))
    )
    within = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.groupBy(*keys, "_bucket", value).agg(F.count(F.lit(1)).alias("_size"))
        .join(target, [*keys, "_bucket"])
        .withColumn("_upto", F.sum("_size").over(within))
        .filter((F.col("_upto") > F.col("_offset")) & (F.col("_upto") - F.col("_size") <= F.col("_offset")))
        .select(*keys, "n", F.col(value).alias(name))
    )


def ordered_positions(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Zero-based global position under a unique ordering.

    The range-partitioned rows are checkpointed, so a lost executor cannot
    re-split them between counting and numbering.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    )
    # One row per range partition: the window below never sees more than that.
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_part", "_before", "_row")
    )


def sorted_positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """The zero-based place of every row of a sorted frame.

    The sorted rows are checkpointed; only the sizes of the sorted partitions are accumulated in one place.
    """
    marked = checkpointed(ordered.withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright("_mark", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(offsets, part == F.col("_part")).withColumn(name, F.col("_before") + inside).drop("_mark", "_part", "_before")
