"""Heat grids as GeoJSON lines, one folder per area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(features: DataFrame, metadata: DataFrame, path: str) -> None:
    """Newline-delimited features, strongest cells first inside each file, and one metadata line per area."""
    features.repartition("area", F.pmod(F.xxhash64("feature"), F.lit(8))).sortWithinPartitions(
        "area", F.col("score").desc()
    ).select("area", "feature").write.mode("overwrite").partitionBy("area").text(f"{path}/features")
    body = F.to_json(F.struct(*[c for c in metadata.columns if c != "area"]))
    metadata.select("area", body.alias("metadata")).write.mode("overwrite").partitionBy("area").text(f"{path}/metadata")
