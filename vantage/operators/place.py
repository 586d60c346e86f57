"""Placing listings without coordinates through a table of geocoder answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.text import trim_all
from vantage.operators.validate import Area, inside_any_area


def geocode_candidates(venue: Column, address: Column, cities: list[str], attempts: int | None = None, chars: int | None = None) -> Column:
    """Queries to try for one listing, best first; all of them, whole, unless limits are given."""
    cities = [c for c in cities if c]
    towns = [c.lower().split(",")[0].strip() for c in cities]

    def names_town(text: Column) -> Column:
        out = F.lit(False)
        for town in towns:
            out = out | F.contains(F.lower(text), F.lit(town))
        return out

    def spots(text: Column) -> Column:
        suffixed = F.array(*[F.concat(text, F.lit(f", {c}")) for c in cities]).cast("array<string>")
        none = F.array().cast("array<string>")
        return F.when(text == "", none).when(names_town(text), F.array(text)).otherwise(suffixed)

    cut = lambda q: F.substring(q, 1, chars) if chars else q
    none = F.array().cast("array<string>")
    both = F.when((venue != "") & (address != ""), F.array(F.concat(venue, F.lit(", "), address))).otherwise(none)
    head = F.when(F.contains(venue, F.lit(",")), F.array(F.substring_index(venue, ",", 1))).otherwise(none)
    tidy = F.transform(
        F.concat(spots(address), spots(venue), both, head),
        lambda q: cut(trim_all(F.regexp_replace(trim_all(q), "^,|,$", ""))),
    )
    distinct = F.array_distinct(F.filter(tidy, lambda q: q != ""))
    return F.slice(distinct, 1, attempts) if attempts else distinct


def placement_backlog(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Unplaced, untried, current listings that name a venue or an address, earliest first."""
    rows = events.filter(
        F.col("lat").isNull() & ~F.col("archived") & ~F.col("geocode_tried")
        & ((F.col("venue_name") != "") | (F.col("address") != ""))
    )
    return rows if limit is None else rows.orderBy("start_ts", "id").limit(limit)


def place_events(backlog: DataFrame, gazetteer: DataFrame, areas: list[Area]) -> DataFrame:
    """(id, lat, lng, query, pending): the first acceptable hit of the first query that has one.

    Listings at the same venue ask the same question, so each distinct venue and
    address pair is resolved once. ``gazetteer`` has (query, hits) with
    lower-cased queries; hits outside every area are refused. ``pending`` marks
    listings with a query the gazetteer has no answer for yet.
    """
    pairs = backlog.select("venue_name", "address").distinct()
    cities = [a.name for a in areas]
    asked = pairs.select(
        "venue_name", "address",
        F.posexplode(geocode_candidates(F.col("venue_name"), F.col("address"), cities)).alias("q_pos", "query"),
    ).withColumn("_key", F.lower(trim_all(F.col("query"))))
    answers = gazetteer.select(F.col("query").alias("_key"), "hits")
    accepted = F.filter(
        "hits", lambda h: inside_any_area(h["lat"], h["lng"], areas)
    )
    looked = asked.join(answers, "_key", "left").withColumn("_hit", F.try_element_at(accepted, F.lit(1)))
    resolved = looked.groupBy("venue_name", "address").agg(
        F.min(F.when(F.col("_hit").isNotNull(), F.struct("q_pos", "query", F.col("_hit.lat").alias("lat"),
                                                        F.col("_hit.lng").alias("lng")))).alias("_best"),
        F.bool_or(F.col("hits").isNull()).alias("_unanswered"),
    )
    return backlog.select("id", "venue_name", "address").join(resolved, ["venue_name", "address"], "left").select(
        "id", "_best.lat", "_best.lng", "_best.query",
        (F.col("_best").isNull() & F.coalesce("_unanswered", F.lit(False))).alias("pending"),
    )


def apply_placements(events: DataFrame, placed: DataFrame) -> DataFrame:
    """Write positions back; listings whose every query was answered are marked as tried."""
    p = placed.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), (~F.col("pending")).alias("_tried"))
    return events.join(p, "id", "left").withColumns({
        "lat": F.coalesce("lat", "_lat"), "lng": F.coalesce("lng", "_lng"),
        "geocode_tried": F.col("geocode_tried") | F.coalesce("_tried", F.lit(False)),
    }).select(*events.columns)


def unanswered_queries(backlog: DataFrame, gazetteer: DataFrame, areas: list[Area]) -> DataFrame:
    """Distinct lower-cased queries still to be put to a geocoder."""
    asked = backlog.select("venue_name", "address").distinct().select(F.explode(
        geocode_candidates(F.col("venue_name"), F.col("address"), [a.name for a in areas])).alias("query"))
    return asked.select(F.lower(trim_all(F.col("query"))).alias("query")).distinct().join(
        gazetteer.select("query"), "query", "left_anti"
    )
