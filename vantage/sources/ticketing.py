"""Landed ticketing-API pages to raw listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions.text import plain_number

RAW_COLUMNS = [
    "source", "source_id", "title", "description", "start_time", "end_time", "venue_name", "address", "lat", "lng",
    "url", "image_url", "category", "price_text", "is_online",
]

TICKETMASTER_SCHEMA = """
_embedded struct<events:array<struct<
  id:string, name:string, url:string, info:string, description:string,
  images:array<struct<url:string,width:int>>,
  dates:struct<start:struct<dateTime:string,localDate:string>>,
  classifications:array<struct<segment:struct<name:string>,genre:struct<name:string>>>,
  priceRanges:array<struct<min:double,max:double,currency:string>>,
  _embedded:struct<venues:array<struct<name:string,address:struct<line1:string>,city:struct<name:string>,
    state:struct<stateCode:string>,location:struct<latitude:string,longitude:string>>>>>>>
"""
SEATGEEK_SCHEMA = """
events array<struct<id:bigint,title:string,url:string,description:string,datetime_utc:string,datetime_local:string,
  venue:struct<name:string,address:string,extended_address:string,location:struct<lat:double,lon:double>>,
  performers:array<struct<image:string>>,taxonomies:array<struct<name:string>>,stats:struct<lowest_price:double>>>
"""
EVENTBRITE_SCHEMA = """
events array<struct<id:string,name:struct<text:string>,summary:string,description:struct<text:string>,url:string,
  start:struct<utc:string>,`end`:struct<utc:string>,
  logo:struct<original:struct<url:string>,url:string>,online_event:boolean,is_free:boolean,
  venue:struct<name:string,address:struct<localized_address_display:string>,latitude:string,longitude:string>>>
"""


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON responses, one page per line or per file."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _joined(sep: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.concat_ws(sep, *[F.when(p != "", p) for p in parts])


def number_text(n: Column) -> Column:
    """Shortest text of a number: whole numbers without a decimal point."""
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(plain_number(n))


def _first(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def raw_row(**fields: Column) -> list[Column]:
    """The raw listing columns, with defaults for whatever a source does not supply."""
    defaults = {
        "end_time": F.lit(None).cast("string"), "lat": F.lit(None).cast("double"),
        "lng": F.lit(None).cast("double"), "is_online": F.lit(False),
    }
    return [fields.get(c, defaults.get(c, F.lit(""))).alias(c) for c in RAW_COLUMNS]


def ticketmaster_events(pages: DataFrame) -> DataFrame:
    e = pages.select(F.explode("_embedded.events").alias("e"))
    start = F.coalesce("e.dates.start.dateTime", F.concat(F.col("e.dates.start.localDate"), F.lit("T12:00:00")))
    venue, cls, price = (_first(F.col(f"e.{c}")) for c in ("_embedded.venues", "classifications", "priceRanges"))
    # Widest image, the first of equally wide ones.
    widest = F.array_min(F.transform("e.images", lambda im, i: F.struct(
        (-F.coalesce(im["width"], F.lit(0))).alias("w"), i.alias("i"), im["url"].alias("url"))))
    shown = lambda c: F.coalesce(number_text(price[c]), F.lit("?"))
    price_text = F.when(price.isNotNull(), F.concat(
        F.coalesce(price["currency"], F.lit("$")), F.lit(" "), shown("min"), F.lit("–"), shown("max")))
    return e.filter(start.isNotNull()).select(*raw_row(
        source=F.lit("ticketmaster"), source_id=F.col("e.id"), title=F.col("e.name"),
        description=F.coalesce("e.info", "e.description", F.lit("")), start_time=start,
        venue_name=_text(venue["name"]),
        address=_joined(", ", venue["address"]["line1"], venue["city"]["name"], venue["state"]["stateCode"]),
        lat=leading_number(venue["location"]["latitude"]), lng=leading_number(venue["location"]["longitude"]),
        url=_text(F.col("e.url")), image_url=_text(widest["url"]),
        category=_joined(" / ", cls["segment"]["name"], cls["genre"]["name"]), price_text=_text(price_text),
    ))


def seatgeek_events(pages: DataFrame) -> DataFrame:
    e = pages.select(F.explode("events").alias("e"))
    utc = F.when(F.col("e.datetime_utc") != "", F.concat(F.col("e.datetime_utc"), F.lit("Z")))
    start = F.coalesce(utc, "e.datetime_local")
    image = _first(F.filter("e.performers", lambda p: F.coalesce(p["image"], F.lit("")) != ""))["image"]
    taxonomy = F.replace(_first(F.col("e.taxonomies"))["name"], F.lit("_"), F.lit(" "))
    return e.filter(F.coalesce(start, F.lit("")) != "").select(*raw_row(
        source=F.lit("seatgeek"), source_id=F.col("e.id").cast("string"), title=F.col("e.title"),
        description=_text(F.col("e.description")), start_time=start, venue_name=_text(F.col("e.venue.name")),
        address=_joined(", ", F.col("e.venue.address"), F.col("e.venue.extended_address")),
        lat=F.col("e.venue.location.lat"), lng=F.col("e.venue.location.lon"), url=_text(F.col("e.url")),
        image_url=_text(image), category=_text(taxonomy),
        price_text=_text(F.concat(F.lit("from $"), number_text(F.col("e.stats.lowest_price")))),
    ))


def eventbrite_events(pages: DataFrame) -> DataFrame:
    e = pages.select(F.explode("events").alias("e"))
    return e.filter(_text(F.col("e.start.utc")) != "").select(*raw_row(
        source=F.lit("eventbrite"), source_id=F.col("e.id"),
        title=F.coalesce("e.name.text", F.lit("Untitled event")),
        description=F.coalesce("e.summary", "e.description.text", F.lit("")), start_time=F.col("e.start.utc"),
        end_time=F.col("e.end.utc"), venue_name=_text(F.col("e.venue.name")),
        address=_text(F.col("e.venue.address.localized_address_display")),
        lat=leading_number(F.col("e.venue.latitude")), lng=leading_number(F.col("e.venue.longitude")),
        url=_text(F.col("e.url")), image_url=F.coalesce("e.logo.original.url", "e.logo.url", F.lit("")),
        category=F.lit("Community"), price_text=F.when(F.col("e.is_free"), "Free").otherwise(""),
        is_online=F.coalesce("e.online_event", F.lit(False)),
    ))
