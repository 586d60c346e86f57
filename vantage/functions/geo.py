"""Distances, boxes, grid geometry and encoded lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111320.0
EARTH_KM = 6371.0


def metres_per_degree_lon(lat: Column) -> Column:
    return F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_KM) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.asin(F.sqrt(a)) * (2 * radius)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2, EARTH_KM * 1000)


def in_box(box: Column, lat: Column, lon: Column) -> Column:
    return lat.between(box["south"], box["north"]) & lon.between(box["west"], box["east"])


def box_from_radius(lat: Column, lon: Column, radius_km: Column) -> Column:
    d_lat = radius_km * 1000 / METRES_PER_DEGREE
    d_lon = radius_km * 1000 / metres_per_degree_lon(lat)
    return F.struct(
        (lat - d_lat).alias("south"), (lon - d_lon).alias("west"),
        (lat + d_lat).alias("north"), (lon + d_lon).alias("east"),
    )


def box_tiles(box: Column, max_span_deg: float) -> Column:
    """array<struct> of tiles no larger than ``max_span_deg`` on either side."""
    rows = F.greatest(F.lit(1), F.ceil((box["north"] - box["south"]) / max_span_deg)).cast("int")
    cols = F.greatest(F.lit(1), F.ceil((box["east"] - box["west"]) / max_span_deg)).cast("int")
    d_lat = (box["north"] - box["south"]) / rows
    d_lon = (box["east"] - box["west"]) / cols
    tile = lambda r: F.transform(
        F.sequence(F.lit(0), cols - 1),
        lambda c: F.struct(
            r.alias("tile_row"), c.alias("tile_col"),
            (box["south"] + r * d_lat).alias("south"), (box["west"] + c * d_lon).alias("west"),
            (box["south"] + (r + 1) * d_lat).alias("north"),
            (box["west"] + (c + 1) * d_lon).alias("east"),
        ),
    )
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), tile))


def grid_of(box: Column, cell_metres: Column) -> Column:
    """struct(d_lat, d_lon, n_rows, n_cols) of the grid laid over a box."""
    d_lat = cell_metres / METRES_PER_DEGREE
    d_lon = cell_metres / metres_per_degree_lon((box["south"] + box["north"]) / 2)
    n_rows = F.greatest(F.lit(1), F.ceil((box["north"] - box["south"]) / d_lat))
    n_cols = F.greatest(F.lit(1), F.ceil((box["east"] - box["west"]) / d_lon))
    return F.struct(
        d_lat.alias("d_lat"), d_lon.alias("d_lon"),
        n_rows.cast("bigint").alias("n_rows"), n_cols.cast("bigint").alias("n_cols"),
    )


def decode_line(encoded: Column) -> Column:
    """Encoded polyline (precision 5) to array<struct<lat, lon>>.

    Splits the text into 5-bit chunks, groups them into numbers at each chunk
    without the continuation bit, then takes running sums of odd and even
    positions.
    """
    pieces = F.regexp_extract_all(encoded, F.lit(r"([_-~]*[?-^])"), 0)

    def number(piece: Column) -> Column:
        bits = F.transform(
            F.split(piece, ""), lambda ch: F.ascii(ch).cast("bigint") - 63
        )
        raw = F.aggregate(
            F.zip_with(bits, F.sequence(F.lit(0), F.size(bits) - 1),
                       lambda b, i: F.call_function("shiftleft", b.bitwiseAND(F.lit(31)), i * 5)),
            F.lit(0).cast("bigint"), lambda acc, v: acc + v,
        )
        half = F.shiftright(raw, 1)
        return F.when(raw.bitwiseAND(F.lit(1)) == 1, -half - 1).otherwise(half)

    steps = F.transform(pieces, number)
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(steps) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(steps, i * 2).alias("d_lat"), F.get(steps, i * 2 + 1).alias("d_lon")),
    )
    start = F.array().cast("array<struct<lat:bigint,lon:bigint>>")

    def advance(acc: Column, step: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.struct(
            (F.coalesce(last["lat"], F.lit(0)) + step["d_lat"]).cast("bigint").alias("lat"),
            (F.coalesce(last["lon"], F.lit(0)) + step["d_lon"]).cast("bigint").alias("lon"),
        )))

    points = F.aggregate(pairs, start, advance)
    degrees = F.transform(
        points, lambda p: F.struct((p["lat"] / 1e5).alias("lat"), (p["lon"] / 1e5).alias("lon"))
    )
    empty = F.array().cast("array<struct<lat:double,lon:double>>")
    return F.when(F.size(steps) >= 2, degrees).otherwise(empty)
