"""Duplicate groups: same title key and UTC date, all members within 300 metres.

Within one (title, date) key events are taken in id order and join the first
group whose every member is close enough. The sequential rule is kept exactly,
while the work is spread out:

* Events at one position always share a group, and events without a position
  always land in the first group, so only the first event of each distinct
  position takes part.
* Keys with few positions are folded inside one row.
* For the rest, a decision depends only on positions within 600 metres, so a
  key is cut into tiles with a margin. Tiles are folded independently; where margins overlap,
  tiles exchange results until nothing changes. Since every decision looks only
  at smaller ids, the unchanged state is the sequential result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.geo import EARTH_KM, haversine_km
from vantage.functions.text import title_key
from vantage.functions.times import utc_date
from vantage.operators.ranking import rank_by_id
from vantage.session import checkpointed

NEAR_KM = 0.3
MARGIN_DEG = 0.0055      # a little over 600 m of latitude
TILE_DEG = 0.02          # about 2.2 km


def event_key(title: Column, start: Column) -> Column:
    return F.concat(title_key(title), F.lit("|"), F.date_format(utc_date(start), "yyyy-MM-dd"))


def group_id(key: Column, index: Column) -> Column:
    return F.substring(F.sha1(F.concat(key, F.lit("#"), index.cast("string"))), 1, 16)


def _tile_columns(tile_row: Column, tile_deg: float) -> Column:
    """Tiles around the globe in one row of tiles."""
    centre = (tile_row + 0.5) * tile_deg
    wide = F.floor(F.cos(F.radians(F.least(F.lit(90.0), F.abs(centre)))) * (360 / tile_deg))
    return F.greatest(F.lit(1), wide).cast("bigint")


def _tile_at(lng: Column, n_cols: Column) -> Column:
    return F.floor((lng + 180) / 360 * n_cols)


def _spread(points: DataFrame, tile_deg: float) -> DataFrame:
    """Each point once in its own tile and once in every tile its margin touches."""
    lat, lng = F.col("lat"), F.col("lng")
    cos_lat = F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + MARGIN_DEG)))
    reach = F.when(cos_lat > MARGIN_DEG / 180, F.lit(MARGIN_DEG) / cos_lat).otherwise(180.0)
    home_row = F.floor(lat / tile_deg)
    rows = points.withColumns({"_reach": reach, "_home_row": home_row}).withColumn(
        "tile_row",
        F.explode(F.sequence(F.floor((lat - MARGIN_DEG) / tile_deg), F.floor((lat + MARGIN_DEG) / tile_deg))),
    ).withColumn("_n", _tile_columns(F.col("tile_row"), tile_deg))
    cols = F.array_distinct(F.transform(
        F.sequence(_tile_at(lng - F.col("_reach"), F.col("_n")), _tile_at(lng + F.col("_reach"), F.col("_n"))),
        lambda c: F.pmod(c, F.col("_n")),
    ))
    placed = rows.withColumn("tile_col", F.explode(cols))
    home_col = F.pmod(_tile_at(lng, F.col("_n")), F.col("_n"))
    own = (F.col("tile_row") == F.col("_home_row")) & (F.col("tile_col") == home_col)
    return placed.withColumn("own", own).drop("_reach", "_home_row", "_n")


def _distances_km(lat: float, lng: float, lats: np.ndarray, lngs: np.ndarray) -> np.ndarray:
    half_lat = np.sin(np.radians(lats - lat) / 2)
    half_lng = np.sin(np.radians(lngs - lng) / 2)
    a = half_lat**2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * half_lng**2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(a))


def _fold_tile(tile: pd.DataFrame) -> pd.DataFrame:
    """First-fit over one tile; rows with a known founder keep it."""
    tile = tile.sort_values("id", kind="stable")
    ids, lats, lngs = (tile[c].to_numpy() for c in ("id", "lat", "lng"))
    known, own = tile["founder"].to_numpy(dtype="float64", na_value=np.nan), tile["own"].to_numpy()
    # Cells at least 0.3 km wide: anything near a point lies in an adjacent cell.
    width = 0.0028 / max(np.cos(np.radians(min(90.0, np.abs(lats).max() + 0.003))), 1e-5)
    east = (lngs - lngs[0] + 180) % 360 - 180
    cells = list(zip(np.floor(lats / 0.0028).astype(int).tolist(), np.floor(east / width).astype(int).tolist()))
    placed: dict[tuple[int, int], list[int]] = {}
    founder_of = np.empty(len(ids), dtype=np.int64)
    sizes: dict[int, int] = {}
    for i in range(len(ids)):
        if np.isnan(known[i]):
            r, c = cells[i]
            around = [(r + dr, c + dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
            earlier = [j for cell in around for j in placed.get(cell, ())]
            chosen = int(ids[i])
            if earlier:
                pos = np.array(earlier)
                close = pos[_distances_km(lats[i], lngs[i], lats[pos], lngs[pos]) <= NEAR_KM]
                names, counts = np.unique(founder_of[close], return_counts=True)
                # Founders ascend, so the first complete match is the oldest group.
                for name, count in zip(names.tolist(), counts.tolist()):
                    if sizes[name] == count:
                        chosen = name
                        break
        else:
            chosen = int(known[i])
        founder_of[i] = chosen
        sizes[chosen] = sizes.get(chosen, 0) + 1
        placed.setdefault(cells[i], []).append(i)
    return pd.DataFrame({"key": tile["key"].to_numpy()[own], "id": ids[own], "founder": founder_of[own]})


def _founders(points: DataFrame, tile_deg: float) -> DataFrame:
    """(key, id, founder) of points whose key has several positions."""
    spread = _spread(points, tile_deg)
    schema = "key string, id bigint, founder bigint"
    fold = lambda view: view.groupBy("key", "tile_row", "tile_col").applyInPandas(_fold_tile, schema)
    first = checkpointed(fold(spread.withColumn("founder", F.lit(None).cast("bigint"))))
    # Only keys with points in a margin depend on another tile.
    linked = spread.filter(~F.col("own")).select("key").distinct()
    settled = first.join(linked, "key", "left_anti")
    current = checkpointed(first.join(linked, "key", "left_semi"))
    views = checkpointed(spread.join(linked, "key", "left_semi"))
    while True:
        known = views.join(current, ["key", "id"], "left").withColumn(
            "founder", F.when(~F.col("own"), F.col("founder"))
        )
        following = checkpointed(fold(known))
        moved = following.join(current, ["key", "id", "founder"], "left_anti").limit(1).count()
        current = following
        if not moved:
            return settled.unionByName(current)


def _fold_row(positions: Column) -> Column:
    """First-fit over a short id-ordered array of positions: array<struct<id, founder>>."""
    start = F.array().cast("array<struct<id:bigint,lat:double,lng:double,founder:bigint>>")

    def add(placed: Column, p: Column) -> Column:
        far = F.filter(placed, lambda m: haversine_km(m["lat"], m["lng"], p["lat"], p["lng"]) > NEAR_KM)
        free = F.array_except(
            F.transform(placed, lambda m: m["founder"]), F.transform(far, lambda m: m["founder"]))
        return F.concat(placed, F.array(F.struct(
            p["id"].alias("id"), p["lat"].alias("lat"), p["lng"].alias("lng"),
            F.coalesce(F.array_min(free), p["id"]).alias("founder"))))

    return F.aggregate(positions, start, add)


def assign_groups(events: DataFrame, tile_deg: float = TILE_DEG, row_limit: int = 64) -> DataFrame:
    """Add dedupe_group to events (id, title, start_ts, lat, lng, ...).

    Keys with up to ``row_limit`` positions are folded in a row, larger ones in tiles.
    """
    keyed = events.withColumn("_key", event_key(F.col("title"), F.col("start_ts")))
    points = checkpointed(
        keyed.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy(F.col("_key").alias("key"), "lat", "lng").agg(F.min("id").alias("id"))
    )
    per_key = points.groupBy("key").agg(F.count(F.lit(1)).alias("_positions"))
    few = per_key.filter(F.col("_positions").between(2, row_limit)).select("key")
    many = per_key.filter(F.col("_positions") > row_limit).select("key")
    in_row = (
        points.join(few, "key", "left_semi").groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("id", "lat", "lng"))).alias("_p"))
        .select("key", F.explode(_fold_row(F.col("_p"))).alias("_m"))
        .select("key", "_m.id", "_m.founder")
    )
    founders = in_row
    crowded = checkpointed(points.join(many, "key", "left_semi"))
    if not crowded.isEmpty():
        founders = founders.unionByName(_founders(crowded, tile_deg))
    indexed = rank_by_id(
        founders.select("key", "founder").distinct(), ["key"], "founder", "_index"
    )
    # Everything else - one position, or none - is in the first group of its key.
    positions = (
        points.join(founders, ["key", "id"]).join(indexed, ["key", "founder"])
        .filter(F.col("_index") > 0)
        .select(F.col("key").alias("_key"), "lat", "lng", "_index")
    )
    return (
        keyed.join(positions, ["_key", "lat", "lng"], "left")
        .withColumn("dedupe_group", group_id(F.col("_key"), F.coalesce(F.col("_index"), F.lit(0))))
        .select(*[c for c in events.columns if c != "dedupe_group"], "dedupe_group")
    )
