"""Gaussian heat grid over weighted observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.geo import box_from_radius, grid_of
from vantage.functions.shoot import ramp_colour
from vantage.functions.text import slug
from vantage.functions.times import half_up, iso
from vantage.operators.ranking import nearest_rank
from vantage.session import checkpointed


def area_dimension(settings: DataFrame, cell_metres: float = 150.0, kernel_metres: float = 300.0,
                   radius_km: float = 5.5) -> DataFrame:
    """Resolve configured areas (name, lat, lng, radius_km, bbox, cell_metres, kernel_metres).

    Missing sizes take the defaults; rows with neither a box nor a point go.
    """
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("Area"))
    derived = F.when(
        F.col("lat").isNotNull() & F.col("lng").isNotNull(),
        box_from_radius(F.col("lat"), F.col("lng"), F.coalesce(F.col("radius_km"), F.lit(radius_km))),
    )
    box = F.coalesce(F.col("bbox"), derived)
    sides = [box[s] for s in ("south", "west", "north", "east")]
    usable = F.lit(True)
    for side in sides:
        usable = usable & side.isNotNull() & ~F.isnan(side) & (F.abs(side) < float("inf"))
    return settings.select(
        name.alias("name"), slug(name).alias("slug"), box.alias("bbox"),
        F.coalesce("cell_metres", F.lit(cell_metres)).alias("cell_metres"),
        F.coalesce("kernel_metres", F.lit(kernel_metres)).alias("kernel_metres"),
        usable.alias("_ok"),
    ).filter("_ok").drop("_ok")


def pick_areas(areas: DataFrame, names: list[str] | None = None) -> DataFrame:
    wanted = [n.strip().lower() for n in names or [] if n.strip()]
    return areas.filter(F.col("slug").isin(wanted) | F.lower("name").isin(wanted)) if wanted else areas


def locate(observations: DataFrame, areas: DataFrame) -> DataFrame:
    """Attach grid row and column; observations outside their area's grid are dropped.

    ``observations`` has (area, obs_id, source, lat, lon, weight, label), where
    area is the slug.
    """
    sized = areas.select(
        F.col("slug").alias("area"), F.col("bbox.south").alias("south"), F.col("bbox.west").alias("west"),
        "cell_metres", "kernel_metres", grid_of(F.col("bbox"), F.col("cell_metres")).alias("g"),
    )
    cell = observations.join(sized, "area").withColumns({
        "row": F.floor((F.col("lat") - F.col("south")) / F.col("g.d_lat")),
        "col": F.floor((F.col("lon") - F.col("west")) / F.col("g.d_lon")),
    })
    return cell.filter(
        F.col("row").between(0, F.col("g.n_rows") - 1) & F.col("col").between(0, F.col("g.n_cols") - 1)
    )


def _smear(cells: DataFrame) -> DataFrame:
    """Every cell once per grid cell its kernel reaches, with the kernel factor.

    The offsets are generated inside the row from the two kernel settings, so
    there is nothing to join.
    """
    reach = F.greatest(F.lit(0), F.ceil(F.col("kernel_metres") / F.col("cell_metres"))).cast("int")
    sigma = F.greatest(F.col("kernel_metres") / 3, F.col("cell_metres") / 2)
    out = cells.withColumn("_dr", F.explode(F.sequence(-reach, reach))).withColumn(
        "_dc", F.explode(F.sequence(-reach, reach))
    )
    dist = F.sqrt((F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc")).cast("double")) * F.col("cell_metres")
    out = out.withColumns({
        "_dist": dist, "_sigma": sigma,
        "r": F.col("row") + F.col("_dr"), "c": F.col("col") + F.col("_dc"),
    }).filter(
        (F.col("_dist") <= F.col("kernel_metres"))
        & F.col("r").between(0, F.col("n_rows") - 1) & F.col("c").between(0, F.col("n_cols") - 1)
    )
    factor = F.exp(-(F.col("_dist") * F.col("_dist")) / (F.col("_sigma") * F.col("_sigma") * 2))
    return out.withColumn("factor", factor)


GRID_COLS = ["area", "cell_metres", "kernel_metres", "n_rows", "n_cols"]


def density_by_source(located: DataFrame) -> DataFrame:
    """(area, r, c, source, raw): kernel sums, from weights summed per cell first."""
    per_cell = located.select("*", "g.n_rows", "g.n_cols").groupBy(*GRID_COLS, "row", "col", "source").agg(
        F.sum("weight").alias("weight")
    )
    return (
        _smear(per_cell).groupBy("area", "r", "c", "source")
        .agg(F.sum(F.col("weight") * F.col("factor")).alias("raw"))
    )


def cell_labels(located: DataFrame) -> DataFrame:
    """(area, r, c, top_name): the label with the single strongest contribution, first one on ties.

    Only the heaviest observations of a cell can win, by the smallest id of each weight, so the rest go before labels
    are compared and the kernel is applied. Weights a rounding error apart stay: their products may be equal.
    """
    cell = [*GRID_COLS, "row", "col"]
    named = located.filter(F.coalesce(F.col("label"), F.lit("")) != "").filter(F.col("weight") > 0)
    named = checkpointed(named.select("*", "g.n_rows", "g.n_cols").select(*cell, "label", "weight", "obs_id"))
    # Sums and ends of numbers are hash aggregates, which hold a row per cell and weight; texts would have to be sorted.
    firsts = named.groupBy(*cell, "weight").agg(
        F.when(F.bool_or(F.col("obs_id").isNull()), F.lit(None)).otherwise(F.min("obs_id")).alias("obs_id"))
    tops = firsts.groupBy(*cell).agg(F.max(F.when(~F.isnan("weight"), F.col("weight"))).alias("_top"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in cell]
    heavy = firsts.alias("f").join(tops.alias("t"), same).filter(
        F.col("_top").isNull() | (F.col("_top") < 1e-290) | (F.col("weight") >= F.col("_top") * (1 - 1e-12))).select("f.*")
    best = named.alias("n").join(
        heavy.alias("h"), [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*cell, "weight", "obs_id"]], "left_semi")
    return (
        _smear(best.select(*cell, "label", "weight", "obs_id")).groupBy("area", "r", "c")
        .agg(F.min_by("label", F.struct(-(F.col("weight") * F.col("factor")), F.col("obs_id"))).alias("top_name"))
    )


def scale_index(percentile: float = 97.0) -> Column:
    last = F.col("n") - 1
    return F.least(last, F.greatest(F.lit(0), half_up(last * (percentile / 100))))


def heat_grid(located: DataFrame, percentile: float = 97.0) -> DataFrame:
    """(area, r, c, raw, score, scale, top_name, breakdown) for every non-empty cell."""
    layers = density_by_source(located)
    cells = layers.groupBy("area", "r", "c").agg(
        # Rounded: the last bits of a sum depend on the order of its terms, and ranks must not.
        F.round(F.sum("raw"), 9).alias("_raw"),
        # One entry per observation source.
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("raw") > 0, F.struct("source", F.round("raw", 3).alias("raw")))))).alias("breakdown"),
    ).filter(F.col("_raw") > 0)
    scale = nearest_rank(cells, ["area"], "_raw", scale_index(percentile), "scale").drop("n")
    return (
        cells.join(scale, "area", "left").fillna(1.0, ["scale"]).join(cell_labels(located), ["area", "r", "c"], "left")
        .withColumns({
            "raw": F.round("_raw", 3),
            "score": F.round(F.least(F.col("_raw") / F.col("scale"), F.lit(1.0)), 4),
        }).drop("_raw")
    )


def by_score(grid: DataFrame) -> DataFrame:
    """Hottest cell first, by area, row and column at ties."""
    return grid.orderBy(F.col("score").desc(), "area", "r", "c")


def cell_bounds(grid: DataFrame, areas: DataFrame) -> DataFrame:
    """Add south, north, west, east of every cell."""
    sized = areas.select(
        F.col("slug").alias("area"), "bbox", grid_of(F.col("bbox"), F.col("cell_metres")).alias("g")
    )
    return grid.join(sized, "area").withColumns({
        "south": F.col("bbox.south") + F.col("r") * F.col("g.d_lat"),
        "north": F.col("bbox.south") + (F.col("r") + 1) * F.col("g.d_lat"),
        "west": F.col("bbox.west") + F.col("c") * F.col("g.d_lon"),
        "east": F.col("bbox.west") + (F.col("c") + 1) * F.col("g.d_lon"),
    }).drop("bbox", "g")


def cell_features(grid: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, score, feature): one GeoJSON feature per cell."""
    at = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(at("west", "south"), at("east", "south"), at("east", "north"), at("west", "north"),
                   at("west", "south"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("score", "raw", F.col("top_name").alias("topName"), "breakdown",
                 ramp_colour(F.col("score")).alias("colour")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return cell_bounds(grid, areas).select(
        "area", "score", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")
    )


def grid_metadata(observations: DataFrame, grid: DataFrame, areas: DataFrame, as_of: Column,
                  hours: int | None = 24, hour_of_day: int | None = None) -> DataFrame:
    """One row per area: label, observation and snapshot counts, scale."""
    counts = observations.groupBy("area").agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("ts").alias("snapshots")
    )
    scale = grid.groupBy("area").agg(F.round(F.max("scale"), 4).alias("normaliseScale"))
    label = F.concat_ws(
        " - ", F.lit("all history" if hours is None else f"last {hours}h"),
        F.lit(None if hour_of_day is None else f"hour {hour_of_day:02d}:00").cast("string"),
        F.concat(F.col("snapshots").cast("string"), F.when(F.col("snapshots") == 1, " snapshot").otherwise(" snapshots")),
    )
    return (
        counts.join(areas.select(F.col("slug").alias("area"), F.col("name").alias("area_name"), "bbox"), "area")
        .join(scale, "area", "left")
        .select("area", label.alias("label"), "area_name", "bbox", "observations", "snapshots",
                # Without a positive cell the scale is the fallback of one.
                F.coalesce("normaliseScale", F.lit(1.0)).alias("normaliseScale"), iso(as_of).alias("generatedAt"))
    )
