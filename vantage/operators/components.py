"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Every round passes the smallest label over the edges and then follows label
    to label once, so long chains take a logarithmic number of rounds.
    """
    both = checkpointed(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter(F.col("a") != F.col("b")).distinct()
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select(
        "node", F.least("node", "_m").alias("label")
    )
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_heard"))
        )
        stepped = labels.join(heard, "node").select(
            "node", F.col("label").alias("_old"), F.least("label", "_heard").alias("label")
        )
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        following = checkpointed(
            stepped.join(hop, "label", "left")
            .select("node", F.least("label", F.coalesce("_next", "label")).alias("label"), "_old")
        )
        moved = following.filter(F.col("label") != F.col("_old")).limit(1).count()
        labels = following.drop("_old")
        if not moved:
            return labels.withColumnRenamed("label", "component")
