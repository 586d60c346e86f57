"""Session settings and checkpointing."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; values that depend on the cluster (memory,
# cores, shuffle partitions) stay with the submitter.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # State of several variables a key, such as the streaks', is only kept by this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "vantage", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through storage that every executor can read.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
    where that is unset (tests) it lies under the home folder of the default
    file system, named after the application, and goes when the process ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            hadoop = context._jvm.org.apache.hadoop.fs
            system = hadoop.FileSystem.get(context._jsc.hadoopConfiguration())
            path = hadoop.Path(system.getHomeDirectory(), f".sparkStaging/checkpoint-{context.applicationId}")
            atexit.register(lambda: context._jsc is not None and system.delete(path, True))
            folder = str(path)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
