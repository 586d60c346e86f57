"""Place links to venue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions import let
from vantage.functions.geo import in_box
from vantage.operators.merge import first_per_key


def parse_place_link(href: Column) -> Column:
    """struct(name, cid, kgmid, lat, lon), null when any part is missing."""
    # A plus in a link is data, not a space, until the name is read.
    return let(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), _place_fields)


def _place_fields(url: Column) -> Column:
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    some = lambda c: F.when(c != "", c)
    encoded = part("!16z([A-Za-z0-9_-]+)")
    padded = F.rpad(
        F.translate(encoded, "-_", "+/"), (F.ceil(F.length(encoded) / 4.0) * 4).cast("int"), F.lit("=")
    )
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    mid = F.coalesce(some(part("!16s([^!?]+)")), F.when(decoded.rlike(r"(?i)^/[a-z]/\w+$"), decoded))
    row = F.struct(
        some(F.replace(part("/maps/place/([^/]+)/"), F.lit("+"), F.lit(" "))).alias("name"),
        some(part("(?i)!1s(0x[0-9a-f]+:0x[0-9a-f]+)")).alias("cid"), mid.alias("kgmid"),
        part(r"!3d(-?[\d.]+)").try_cast("double").alias("lat"), part(r"!4d(-?[\d.]+)").try_cast("double").alias("lon"),
    )

    def complete(r: Column) -> Column:
        missing = F.lit(False)
        for name in ("name", "cid", "kgmid", "lat", "lon"):
            missing = missing | r[name].isNull()
        return F.when(~missing, r)

    return let(row, complete)


def discovered_venues(links: DataFrame, boxes: DataFrame) -> DataFrame:
    """Venue rows from (area, term, term_pos, link_pos, href): inside the area, first sighting wins."""
    parsed = links.withColumn("v", parse_place_link(F.col("href"))).filter(F.col("v").isNotNull()).select(
        "area", "term", "term_pos", "link_pos", "v.*"
    )
    inside = parsed.join(boxes.select(F.col("slug").alias("area"), "bbox"), "area").filter(
        in_box(F.col("bbox"), F.col("lat"), F.col("lon"))
    ).drop("bbox")
    return first_per_key(inside, ["area", "cid"], ["term_pos", "link_pos"])
