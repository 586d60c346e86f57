"""The event table as hash buckets of its key, so that a batch rewrites only the buckets it touches.

A batch is merged in three steps: the touched buckets are read and merged with it, the merged rows go to a journal, and the
buckets are overwritten from the journal. A step that is cut short is done again when the batch is: until the journal has the
batch, no bucket has changed; once it has, only the overwriting is repeated. The journal keeps two batches in turns and the
largest id given so far, so no step reads buckets that the batch doesn't touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from vantage.operators.merge import CONTENT, EVENT_KEY, KEPT_DEFAULTS, upsert_events

BUCKETS = 256


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*EVENT_KEY), F.lit(buckets)).cast("int")


def stored_schema(batch: DataFrame) -> StructType:
    """Columns of the table that batches like this one are merged into."""
    kept = [F.expr(default).alias(c) for c, default in KEPT_DEFAULTS.items()]
    return batch.limit(0).select(F.lit(0).cast("bigint").alias("id"), *EVENT_KEY, *CONTENT, *kept).schema


def _folder(spark: SparkSession, path: str, schema: StructType, part: str) -> DataFrame:
    """A partitioned Parquet folder, made without rows if it isn't there."""
    whole = StructType([*schema.fields]).add(part, IntegerType())
    spark.createDataFrame([], whole).write.mode("append").partitionBy(part).parquet(path)
    return spark.read.schema(whole).parquet(path)


def read_events(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    return _folder(spark, table, schema, "bucket").drop("bucket")


def _replace(rows: DataFrame, path: str, part: str) -> None:
    """Overwrite the parts that the rows belong to, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def upsert_batch(batch: DataFrame, epoch: int, table: str, order: list[str], buckets: int = BUCKETS) -> list[int]:
    """Merge a batch into the table; returns the rewritten buckets, at most ``buckets``.

    The same epoch again leaves the table as the first time. Epochs count up by one.
    """
    spark, schema = batch.sparkSession, stored_schema(batch)
    noted = StructType([*schema.fields]).add("bucket", IntegerType()).add("epoch", LongType()).add("top", LongType())
    journal, slot = f"{table}-journal", epoch % 2
    mine = (F.col("slot") == slot) & (F.col("epoch") == epoch)
    if _folder(spark, journal, noted, "slot").filter(mine).isEmpty():
        batch = batch.withColumn("bucket", bucket_of(buckets)).persist()
        try:
            touched = [r[0] for r in batch.select("bucket").distinct().collect()]
            if not touched:
                return []
            current = _folder(spark, table, schema, "bucket").filter(F.col("bucket").isin(touched))
            top = _folder(spark, journal, noted, "slot").agg(F.coalesce(F.max("top"), F.lit(0))).first()[0]
            merged = upsert_events(current, batch, order, top=top)
            highest = merged.agg(F.greatest(F.max("id"), F.lit(top))).first()[0]
            _replace(merged.withColumns({"bucket": bucket_of(buckets), "epoch": F.lit(epoch).cast("bigint"), "top": F.lit(highest), "slot": F.lit(slot)}), journal, "slot")
        finally:
            batch.unpersist()
    merged = _folder(spark, journal, noted, "slot").filter(mine).select(*schema.fieldNames(), "bucket")
    _replace(merged.repartition("bucket"), table, "bucket")
    return sorted(r[0] for r in merged.select("bucket").distinct().collect())
