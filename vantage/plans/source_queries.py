"""Registered queries over sources, sinks, traffic, light and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions import geo, shoot, text
from vantage.functions.astro import moon, with_sun
from vantage.operators import areas, conditions as cond
from vantage.operators import grid, merged, views
from vantage.operators.validate import Area
from vantage.plans import bindings as b
from vantage.plans.bindings import haversine_sql
from vantage.plans.light_sql import label_sql, score_sql, sun_sql, why_sql
from vantage.plans.listing_queries import _HEADS, _heads
from vantage.plans.registry import query, time_sql, time_text
from vantage.sinks import ics
from vantage.sources import calendar_feed, forecast, panels, places, registry, structured, ticketing, traffic, weblinks
from vantage.sources import observations as ob

ISO_DAY = "yyyy-MM-dd'T'HH:mm:ss'Z'"


# --- listing sources ------------------------------------------------------------------------


def _named(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def ticketmaster_pages(spark, sf):
    """One landed page per order, as JSON text parsed with the source's schema."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    event = _named(
        id=F.concat(F.lit("tm"), k), name=F.concat(F.lit("Order "), k),
        description=F.when(k % 2 == 0, F.concat(F.lit("About "), k)),
        images=F.array(_named(url=F.concat(F.lit("a"), k), width=F.lit(150)), _named(url=F.concat(F.lit("b"), k), width=k % 300)),
        dates=_named(start=_named(dateTime=F.when(k % 3 == 0, F.date_format(day, ISO_DAY)),
                                  localDate=F.when(k % 3 == 1, F.date_format(day, "yyyy-MM-dd")))),
        classifications=F.array(_named(segment=_named(name=F.col("o_orderpriority")),
                                       genre=_named(name=F.when(k % 2 == 0, "Rock")))),
        priceRanges=F.when(k % 4 != 0, F.array(_named(min=F.col("o_totalprice"), currency=F.when(k % 5 != 0, "USD")))),
        _embedded=_named(venues=F.array(_named(
            name=F.concat(F.lit("Hall "), F.col("o_custkey")), address=_named(line1=F.concat(k, F.lit(" Main St"))),
            city=_named(name=F.when(k % 7 != 0, "Kelso")), state=_named(stateCode=F.lit("NSW")),
            location=_named(latitude=F.lit("-33.5"), longitude=F.when(k % 2 == 0, "149.5"))))),
    )
    page = F.to_json(F.struct(F.struct(F.array(event).alias("events")).alias("_embedded")))
    rows = b.table(spark, sf, "orders").select(page.alias("json"))
    return rows.select(F.from_json("json", ticketing.TICKETMASTER_SCHEMA.replace("\n", " ")).alias("p")).select("p.*")


@query("a1_ticketing_pages", """
SELECT 'tm' || o_orderkey AS source_id, 'Order ' || o_orderkey AS title,
  CASE WHEN o_orderkey % 2 = 0 THEN 'About ' || o_orderkey ELSE '' END AS description,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T12:00:00' END AS start_time,
  'Hall ' || o_custkey AS venue_name, o_orderkey || ' Main St' || CASE WHEN o_orderkey % 7 <> 0 THEN ', Kelso' ELSE '' END || ', NSW' AS address,
  CASE WHEN o_orderkey % 2 = 0 THEN 149.5::DOUBLE END AS lng, CASE WHEN o_orderkey % 300 > 150 THEN 'b' ELSE 'a' END || o_orderkey AS image_url,
  o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' / Rock' ELSE '' END AS category,
  CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 5 <> 0 THEN 'USD' ELSE '$' END || ' ' ||
    CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END || '–?' ELSE '' END AS price_text
FROM orders WHERE o_orderkey % 3 <> 2""")
def ticketing_rows(spark, sf):
    return ticketing.ticketmaster_events(ticketmaster_pages(spark, sf)).select(
        "source_id", "title", "description", "start_time", "venue_name", "address", "lng", "image_url", "category", "price_text")


def seatgeek_pages(spark, sf):
    k = F.col("o_orderkey")
    event = _named(
        id=k, title=F.concat(F.lit("Show "), k), datetime_utc=F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")),
        datetime_local=F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'12:mm:ss")),
        venue=_named(name=F.lit("Arena"), address=F.when(k % 2 == 0, "1 Road"), extended_address=F.lit("Kelso"),
                     location=_named(lat=F.lit(-33.4), lon=F.lit(149.5))),
        performers=F.array(_named(image=F.when(k % 4 == 0, F.concat(F.lit("p"), k))), _named(image=F.concat(F.lit("q"), k))),
        taxonomies=F.array(_named(name=F.lit("theater_shows"))), stats=_named(lowest_price=F.when(k % 5 == 0, (k % 90).cast("double"))),
    )
    page = F.to_json(F.struct(F.array(event).alias("events")))
    rows = b.table(spark, sf, "orders").select(page.alias("json"))
    return rows.select(F.from_json("json", ticketing.SEATGEEK_SCHEMA.replace("\n", " ")).alias("p")).select("p.*")


@query("a2_ticketing_pages", """
SELECT o_orderkey::VARCHAR AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z'
    ELSE strftime(o_orderdate, '%Y-%m-%dT12:%M:%S') END AS start_time,
  CASE WHEN o_orderkey % 2 = 0 THEN '1 Road, ' ELSE '' END || 'Kelso' AS address,
  CASE WHEN o_orderkey % 4 = 0 THEN 'p' ELSE 'q' END || o_orderkey AS image_url, 'theater shows' AS category,
  CASE WHEN o_orderkey % 5 = 0 THEN 'from $' || (o_orderkey % 90) ELSE '' END AS price_text
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def seatgeek_rows(spark, sf):
    return ticketing.seatgeek_events(seatgeek_pages(spark, sf)).select(
        "source_id", "start_time", "address", "image_url", "category", "price_text")


def eventbrite_pages(spark, sf):
    k = F.col("o_orderkey")
    event = _named(
        id=F.concat(F.lit("eb"), k), name=_named(text=F.when(k % 9 != 0, F.concat(F.lit("Fair "), k))),
        summary=F.when(k % 2 == 0, "short"), description=_named(text=F.lit("long")), url=F.concat(F.lit("https://e.example.org/"), k),
        start=_named(utc=F.when(k % 4 != 0, F.date_format("o_orderdate", ISO_DAY))), end=_named(utc=F.date_format("o_orderdate", ISO_DAY)),
        logo=_named(original=_named(url=F.when(k % 3 == 0, "big")), url=F.lit("small")), online_event=k % 5 == 0, is_free=k % 6 == 0,
        venue=_named(name=F.lit("Hall"), address=_named(localized_address_display=F.lit("1 Road, Kelso")), latitude=F.lit("-33.4"),
                     longitude=F.lit("149.5")),
    )
    page = F.to_json(F.struct(F.array(event).alias("events")))
    rows = b.table(spark, sf, "orders").select(page.alias("json"))
    return rows.select(F.from_json("json", ticketing.EVENTBRITE_SCHEMA.replace("\n", " ")).alias("p")).select("p.*")


@query("a3_organiser_pages", """
SELECT 'eb' || o_orderkey AS source_id, CASE WHEN o_orderkey % 9 <> 0 THEN 'Fair ' || o_orderkey ELSE 'Untitled event' END AS title,
  CASE WHEN o_orderkey % 2 = 0 THEN 'short' ELSE 'long' END AS description, CASE WHEN o_orderkey % 3 = 0 THEN 'big' ELSE 'small' END AS image_url,
  'Community' AS category, CASE WHEN o_orderkey % 6 = 0 THEN 'Free' ELSE '' END AS price_text, o_orderkey % 5 = 0 AS is_online
FROM orders WHERE o_orderkey % 4 <> 0""")
def eventbrite_rows(spark, sf):
    return ticketing.eventbrite_events(eventbrite_pages(spark, sf)).select(
        "source_id", "title", "description", "image_url", "category", "price_text", "is_online")


@query("g1_j3_gathered_sources", """
SELECT 'ticketmaster' AS source, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS placed FROM orders WHERE o_orderkey % 3 <> 2
UNION ALL SELECT 'seatgeek', count(*), count(*) FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
UNION ALL SELECT 'eventbrite', count(*), count(*) FROM orders WHERE o_orderkey % 4 <> 0""")
def gathered(spark, sf):
    sources = [registry.Source("ticketmaster", "Ticketmaster", ticketing.ticketmaster_events),
               registry.Source("seatgeek", "SeatGeek", ticketing.seatgeek_events),
               registry.Source("eventbrite", "Eventbrite", ticketing.eventbrite_events)]
    landed = {"ticketmaster": ticketmaster_pages(spark, sf), "seatgeek": seatgeek_pages(spark, sf), "eventbrite": eventbrite_pages(spark, sf)}
    rows = registry.gather(landed, sources, b.as_of())
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lng").isNotNull()).alias("placed"))


@query("a4_calendar_feeds", """
SELECT substr(sha1('https://cal.example.org/' || o_orderkey), 1, 8) || ':' ||
    CASE WHEN o_orderkey % 2 = 0 THEN 'uid-' || o_orderkey ELSE sha1('https://cal.example.org/' || o_orderkey || '|Order, ' || o_orderkey || '|' ||
      strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S.000Z')) END AS source_id,
  'Order, ' || o_orderkey AS title, 'line one' || chr(10) || 'priority ' || o_orderpriority AS description,
  strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS start_time, 'Feed ' || (o_custkey % 5) AS venue_name,
  CASE WHEN o_orderkey % 3 = 0 THEN -33.4::DOUBLE END AS lat
FROM orders WHERE o_orderdate + INTERVAL 9 HOUR >= TIMESTAMP '1998-03-01 12:00:00' - INTERVAL 24 HOUR
  AND o_orderdate + INTERVAL 9 HOUR <= TIMESTAMP '1998-09-01 12:00:00'""")
def calendar_rows(spark, sf):
    k = F.col("o_orderkey")
    crlf = "\r\n"
    lines = F.concat_ws(
        crlf, F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.when(k % 2 == 0, F.concat(F.lit("UID:uid-"), k)),
        F.date_format("o_orderdate", "'DTSTART:'yyyyMMdd'T090000Z'"), F.concat(F.lit("SUMMARY:Order\\, "), k),
        F.concat(F.lit("DESCRIPTION:line one\\npriori"), F.lit(crlf + " ty "), "o_orderpriority"),
        F.when(k % 3 == 0, F.lit("GEO:-33.4;149.5")), F.lit("END:VEVENT"), F.lit("BEGIN:VEVENT"), F.lit("SUMMARY:no start"),
        F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    feeds = b.table(spark, sf, "orders").select(
        F.concat(F.lit("https://cal.example.org/"), k).alias("feed_url"), F.concat(F.lit("Feed "), F.col("o_custkey") % 5).alias("feed_name"),
        lines.alias("text"))
    rows = calendar_feed.calendar_events(feeds, F.lit("1998-03-01 12:00:00").cast("timestamp"))
    return rows.select("source_id", "title", "description", "start_time", "venue_name", "lat")


@query("a5_structured_events", """
WITH o AS (SELECT o_orderkey AS k, o_orderdate, o_totalprice, 'https://site' || (o_orderkey % 50) || '.example.org/' || o_orderkey AS page FROM orders)
SELECT page AS page_url, page || '#main' AS source_id, 'Order ' || k AS title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS start_time,
  'Hall' AS venue_name, '1 Road, Kelso, NSW' AS address, -33.4::DOUBLE AS lat, 'Music' AS category,
  CASE WHEN k % 10 = 0 THEN 'Free' ELSE 'from ' || (k % 10) END AS price_text, k % 2 = 0 AS is_online FROM o
UNION ALL SELECT page, page, 'Part of ' || k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z'), 'Side room', '', NULL, 'Event', '', false FROM o WHERE k % 3 = 0""")
def structured_rows(spark, sf):
    k = F.col("o_orderkey")
    page = F.concat(F.lit("https://site"), k % 50, F.lit(".example.org/"), k)
    day = F.date_format("o_orderdate", ISO_DAY)
    sub = F.when(k % 3 == 0, F.concat(
        F.lit(', "subEvent": [{"@type": ["Thing", "https://schema.org/Event"], "name": [[[["", {"name": ""}, "Part of '), k, F.lit('"]]], "x"], "startDate": "'), day,
        F.lit('", "location": "Side room"}, {"@type": "Event", "name": "no date"}]'))).otherwise("")
    block = F.concat(
        F.lit('{"@graph": [{"@type": "WebPage", "name": "x"}, {"item": {"@type": "MusicEvent", "name": "Order '), k, F.lit('", "startDate": "'), day,
        F.lit('", "url": [[], [["'), page, F.lit('#main"]]], "location": [[{"name": "Hall", "address": {"streetAddress": "1 Road", "addressLocality": "Kelso", '
              '"addressRegion": "NSW"}, "geo": {"latitude": "-33.4", "longitude": 149.5}}], "elsewhere"], "offers": [{"price": "'), k % 10,
        F.lit('"}], "eventAttendanceMode": "'), F.when(k % 2 == 0, "https://schema.org/OnlineEventAttendanceMode").otherwise("x"),
        F.lit('"'), sub, F.lit("}}]};"))
    html = F.concat(F.lit("<html><script>var a=1</script><script type='application/ld+json'>{broken</script>"
                          '<SCRIPT data-x="1" type="application/ld+json">\n'), block, F.lit("\n</SCRIPT>"), F.lit(
        '<script type="application/ld+json">{"@type": "Event", "name": "repeat", "startDate": "2020-01-01", "url": "'), page, F.lit('#main"}</script></html>'))
    landed = b.table(spark, sf, "orders").select(page.alias("page_url"), html.alias("html")).unionByName(
        b.table(spark, sf, "pages").select(F.col("url").alias("page_url"), "html"))
    return structured.page_events(landed).select(
        "page_url", "source_id", "title", "start_time", "venue_name", "address", "lat", "category", "price_text", "is_online")


@query("a6_c13_candidate_pages", """
WITH links AS (SELECT page_id // 10 AS query_pos, page_id % 10 AS link_pos, CASE WHEN page_id % 7 = 0 THEN 'https://m.facebook.com/p' || page_id ELSE url END AS url FROM pages),
h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host FROM links),
k AS (SELECT *, split_part(url, '#', 1) AS page_url FROM h WHERE host <> '' AND NOT regexp_matches(host,
  '(^|\\.)(facebook|instagram|twitter|x|tiktok|youtube|songkick|bandsintown|ticketmaster|seatgeek)\\.com$'))
SELECT page_url, any_value(host) AS host, min(query_pos * 10 + link_pos) // 10 AS query_pos, min(query_pos * 10 + link_pos) % 10 AS link_pos FROM k GROUP BY page_url""")
def candidates(spark, sf):
    p = F.col("page_id")
    links = b.table(spark, sf, "pages").select(
        F.floor(p / 10).alias("query_pos"), (p % 10).alias("link_pos"),
        F.when(p % 7 == 0, F.concat(F.lit("https://m.facebook.com/p"), p)).otherwise(F.col("url")).alias("url"))
    return weblinks.candidate_pages(links)


@query("c13_skipped_by_table", """
WITH h AS (SELECT page_id // 10 AS query_pos, page_id % 10 AS link_pos, split_part(url, '#', 1) AS page_url,
  regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages),
skipped AS (SELECT substr(host, instr(host, '.') + 1) AS host FROM h WHERE query_pos % 3 = 0 AND len(string_split(host, '.')) > 3
  UNION SELECT host FROM h WHERE link_pos = 4 AND query_pos % 5 = 0),
k AS (SELECT h.* FROM h WHERE host <> '' AND link_pos < 8 AND NOT EXISTS (SELECT 1 FROM skipped s WHERE h.host = s.host OR ends_with(h.host, '.' || s.host)))
SELECT page_url, any_value(host) AS host, min(query_pos * 10 + link_pos) // 10 AS query_pos, min(query_pos * 10 + link_pos) % 10 AS link_pos FROM k GROUP BY page_url""")
def skipped_by_table(spark, sf):
    p = F.col("page_id")
    links = b.table(spark, sf, "pages").select(F.floor(p / 10).alias("query_pos"), (p % 10).alias("link_pos"), "url")
    hosts = links.withColumn("host", text.host_of(F.col("url")))
    parent = F.substring("host", F.instr("host", ".") + 1, F.length("host"))
    skipped = hosts.filter((F.col("query_pos") % 3 == 0) & (F.size(F.split("host", r"\.")) > 3)).select(parent.alias("host")).union(
        hosts.filter("link_pos = 4 AND query_pos % 5 = 0").select("host")).distinct()
    return weblinks.candidate_pages(links, 8, skipped)


@query("h35_social_profiles", """
WITH l AS (SELECT page_id % 40 AS group_key, page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.facebook.com/Club' || (page_id % 12) || '/posts'
  WHEN 1 THEN 'https://x.com/@team' || (page_id % 9) WHEN 2 THEN 'https://facebook.com/events/' || page_id ELSE url END AS url FROM pages),
s AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN 'Facebook' ELSE 'X' END AS network,
  CASE WHEN page_id % 4 = 0 THEN 'Club' || (page_id % 12) ELSE 'team' || (page_id % 9) END AS handle FROM l WHERE page_id % 4 < 2)
SELECT group_key, network, arg_min(handle, url) AS handle, min(url) AS url FROM s GROUP BY group_key, network, lower(handle)""")
def socials(spark, sf):
    p = F.col("page_id")
    url = F.when(p % 4 == 0, F.concat(F.lit("https://www.facebook.com/Club"), p % 12, F.lit("/posts"))).when(
        p % 4 == 1, F.concat(F.lit("https://x.com/@team"), p % 9)).when(
        p % 4 == 2, F.concat(F.lit("https://facebook.com/events/"), p)).otherwise(F.col("url"))
    links = b.table(spark, sf, "pages").select((p % 40).alias("group_key"), url.alias("url"), F.lit(True).alias("from_source"),
                                               F.lit(None).cast("int").alias("text_pos"))
    return views.social_profiles(links)


_LOG = """log AS (SELECT source, lang AS area, count(*) AS fetched,
  CASE WHEN source = 'src0' THEN 'missing' WHEN source = 'src1' OR (source = 'src2' AND lang = 'en') THEN 'failed' ELSE 'ok' END AS outcome
  FROM documents GROUP BY ALL)"""


@query("d16_c8_source_status", f"""
WITH {_LOG}, seen AS (SELECT source, count(*) AS areas, count(*) FILTER (outcome = 'failed') AS failed, bool_or(outcome = 'missing') AS missing,
  coalesce(sum(fetched) FILTER (outcome = 'ok'), 0)::BIGINT AS total FROM log GROUP BY source),
state AS (SELECT *, CASE WHEN missing THEN 'missing_config' WHEN failed = areas THEN 'error' ELSE 'ok' END AS state FROM seen),
catalogue AS (SELECT DISTINCT source, upper(source) AS label FROM documents UNION ALL SELECT 'other', 'OTHER')
SELECT c.source, c.label, coalesce(state, 'never_run') AS state, CASE WHEN state = 'ok' THEN total WHEN state IS NULL THEN 0 ELSE 7 END AS count,
  CASE WHEN state IS NULL THEN 'Not fetched yet' WHEN state = 'missing_config' THEN 'no key' WHEN state = 'error' THEN 'timeout'
    ELSE 'Fetched ' || total || ' events' || CASE WHEN areas > 1 THEN ' across ' || areas || ' areas' ELSE '' END
      || CASE WHEN failed > 0 THEN ' (' || failed || ' area failed)' ELSE '' END END AS message,
  CASE WHEN state IS NOT NULL THEN '2024-02-12 06:00:00' WHEN source <> 'other' THEN '2024-01-01 00:00:00' END AS last_fetch
FROM catalogue c LEFT JOIN state USING (source)""")
def source_status(spark, sf):
    docs = b.table(spark, sf, "documents")
    failed = (F.col("source") == "src1") | ((F.col("source") == "src2") & (F.col("area") == "en"))
    outcome = F.when(F.col("source") == "src0", "missing").when(failed, "failed").otherwise("ok")
    log = docs.groupBy("source", F.col("lang").alias("area")).agg(F.count(F.lit(1)).alias("fetched")).withColumn("outcome", outcome).withColumn(
        "reason", F.when(F.col("outcome") == "missing", "no key").otherwise("timeout"))
    known = docs.select("source").distinct()
    previous = known.select("source", F.lit("ok").alias("state"), F.lit("old").alias("message"), F.lit(7).cast("bigint").alias("count"),
                            F.lit("2024-01-01").cast("timestamp").alias("last_fetch"))
    catalogue = known.select("source", F.upper("source").alias("label"), F.lit(False).alias("unofficial")).unionByName(
        spark.range(1).select(F.lit("other").alias("source"), F.lit("OTHER").alias("label"), F.lit(False).alias("unofficial")))
    return registry.source_catalogue(catalogue, registry.status_rollup(log, previous, F.lit("2024-02-12 06:00:00").cast("timestamp")))\
        .withColumn("last_fetch", time_text(F.col("last_fetch"))).drop("unofficial")


@query("g6_event_areas", """
WITH n AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN -33.0 - (s_suppkey % 50)::DOUBLE / 10 END AS lat,
  CASE WHEN s_suppkey % 4 = 0 THEN 149.0::DOUBLE END AS lng, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 40)::DOUBLE + 1 END AS radius FROM supplier),
hits AS (SELECT 'customer#' || lpad(c_custkey::VARCHAR, 9, '0') AS query, -30.0 - (c_custkey % 9)::DOUBLE AS lat, c_nationkey::DOUBLE + 100 AS lng FROM customer WHERE c_custkey % 5 <> 1),
asked AS (SELECT k, CASE WHEN k % 2 = 0 THEN name ELSE replace(name, 'Supplier', 'Customer') END AS name, lat, lng, radius FROM n WHERE k % 7 <> 5)
SELECT 'Home' AS name, -33.4::DOUBLE AS lat, 149.5::DOUBLE AS lng, 25.0::DOUBLE AS radius_km
UNION ALL SELECT a.name, CASE WHEN a.lat IS NULL OR a.lng IS NULL THEN h.lat ELSE a.lat END, CASE WHEN a.lat IS NULL OR a.lng IS NULL THEN h.lng ELSE a.lng END, coalesce(radius, 25.0)
FROM asked a LEFT JOIN hits h ON (a.lat IS NULL OR a.lng IS NULL) AND h.query = lower(a.name) WHERE h.query IS NOT NULL OR (a.lat IS NOT NULL AND a.lng IS NOT NULL)""")
def event_areas(spark, sf):
    k = F.col("s_suppkey")
    named = F.when(k % 2 == 0, F.col("s_name")).otherwise(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))
    extra = b.table(spark, sf, "supplier").select(
        k.alias("position"), F.when(k % 7 == 5, "  ").otherwise(F.concat(F.lit(" "), named)).alias("name"),
        F.when(k % 2 == 0, -33.0 - (k % 50).cast("double") / 10).alias("lat"), F.when(k % 4 == 0, F.lit(149.0)).alias("lng"),
        F.when(k % 3 == 0, (k % 40).cast("double") + 1).alias("radius_km"))
    c = F.col("c_custkey")
    hit = F.struct(F.lit("x").alias("display_name"), (-30.0 - (c % 9).cast("double")).alias("lat"), (F.col("c_nationkey").cast("double") + 100).alias("lng"))
    gazetteer = b.table(spark, sf, "customer").select(F.lower("c_name").alias("query"), F.when(c % 5 != 1, F.array(hit)).alias("hits"))
    return areas.event_areas(extra, gazetteer, 25.0, Area("Home", -33.4, 149.5, 25.0)).drop("position")


# --- panels and places -----------------------------------------------------------------------------


@query("a7_d15_panel_readings", f"""
WITH {b.OBS_SQL}, {b.VENUE_SQL},
cap AS (SELECT event_id, ts, 'area-' || (user_id % 3) AS area, user_id::VARCHAR AS cid, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  hour(ts + INTERVAL {b.TZ_HOURS} HOUR) AS hour FROM events),
read_ AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN k END AS live,
  CASE WHEN event_id % 3 = 0 THEN 100 - k WHEN event_id % 3 = 1 AND hour = 15 THEN greatest(k, 99 - k) END AS typical FROM cap)
SELECT r.cid, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN live IS NOT NULL THEN 'live' ELSE 'typical' END AS kind,
  coalesce(live, typical)::DOUBLE / 100 AS weight, live, typical, hour::INTEGER AS hour
FROM read_ r JOIN venues v ON v.area = r.area AND v.cid = r.cid WHERE coalesce(live, typical) IS NOT NULL""")
def panel_rows(spark, sf):
    return panels.panel_readings(_captures(spark, sf), b.venues(spark, sf), b.TZ).withColumn(
        "m", F.from_json("meta", "live int, typical int, hour int")).select(
        "cid", time_text(F.col("ts")).alias("ts"), "kind", "weight", "m.live", "m.typical", "m.hour")


def _captures(spark, sf):
    base = b.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e, k = F.col("event_id") % 3, F.col("k")
    says = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    labels = F.when(e == 0, F.array(says("Currently ", k, "% busy, usually ", 100 - k, "% busy."))).when(
        e == 1, F.array(says(k, "% busy at 3 pm."), F.lit(None).cast("string"), says(99 - k, "% busy at 3 PM."), says(k, "% busy at ten"))
    ).otherwise(F.array(F.lit("No panel")))
    day = lambda d: F.transform(F.sequence(F.lit(8), F.lit(11)), lambda h: F.concat(
        ((F.col("user_id") * 7 + d * 13 + h * 11) % 101).cast("string"), F.lit("% busy at "), h.cast("string"), F.lit(" am.")))
    week = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.when(d == F.col("user_id") % 7, F.array().cast("array<string>")).otherwise(day(d)))
    return base.select(
        F.concat(F.lit("area-"), F.col("user_id") % 3).alias("area"), F.col("user_id").cast("string").alias("cid"), "ts",
        labels.alias("labels"), F.when(e == 0, week).alias("day_labels"), F.col("event_id"))


@query("d14_week_profiles", """
WITH cap AS (SELECT event_id, user_id FROM events WHERE event_id % 3 = 0),
bars AS (SELECT event_id, d, h, (user_id * 7 + d * 13 + h * 11) % 101 AS pct FROM cap, range(7) a(d), range(8, 12) c(h) WHERE d <> user_id % 7),
totals AS (SELECT event_id, d, sum(pct) AS t FROM bars GROUP BY ALL HAVING sum(pct) > 0),
pick AS (SELECT event_id, arg_min(d, -t * 10 + d) AS busy_d, arg_min(d, t * 10 + d) AS quiet_d, count(*) AS open_days FROM totals GROUP BY event_id)
SELECT p.event_id, busy_d::INTEGER AS busiest_day_index, quiet_d::INTEGER AS quietest_day_index, open_days::INTEGER AS open_days,
  arg_min(h, -pct * 100 + h)::INTEGER AS busiest_hour, max(pct)::INTEGER AS busiest_peak
FROM pick p JOIN bars b ON b.event_id = p.event_id AND b.d = p.busy_d GROUP BY ALL""")
def week_profiles(spark, sf):
    rows = _captures(spark, sf).select("event_id", panels.week_profile(F.col("day_labels")).alias("w")).filter(F.col("w").isNotNull())
    names = F.array(*[F.lit(d) for d in vocab.DAY_NAMES])
    return rows.select("event_id", "w.busiest_day_index", (F.array_position(names, F.col("w.quietest_day")) - 1).cast("int").alias("quietest_day_index"),
                       F.size("w.open_days").alias("open_days"), "w.busiest_hour", "w.busiest_peak")


@query("d21_capture_quality", f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, hour(ts + INTERVAL {b.TZ_HOURS} HOUR) AS hour FROM events)
SELECT 'area-' || (user_id % 3) AS area, count(*) AS venues, count(*) FILTER (event_id % 3 = 0) AS with_live,
  count(*) FILTER (event_id % 3 = 1 AND hour = 15) AS with_typical, count(*) FILTER (event_id % 3 = 0) AS profiles_updated, count(*) FILTER (user_id % 2 = 0) AS quick_checked
FROM e GROUP BY ALL""")
def capture_quality(spark, sf):
    seen = _captures(spark, sf)
    waits = seen.select("area", "cid").distinct().withColumn("wait_ms", F.when(F.col("cid").cast("long") % 2 == 0, 3500).otherwise(13000))
    return panels.capture_quality(seen, waits, b.TZ)


@query("a9_place_links", """
SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Cafe ' || c_custkey END AS name, CASE WHEN c_custkey % 5 <> 0 THEN '0xa' || c_custkey || ':0xb1' END AS cid,
  CASE WHEN c_custkey % 5 <> 0 THEN '/m/0' || c_custkey END AS kgmid, CASE WHEN c_custkey % 5 <> 0 THEN -33.25::DOUBLE END AS lat, c_custkey AS k FROM customer""")
def place_links(spark, sf):
    k = F.col("c_custkey")
    mid = F.concat(F.lit("/m/0"), k)
    coded = F.rtrim(F.translate(F.base64(mid.cast("binary")), "+/", "-_"), F.lit("="))
    href = F.concat(
        F.lit("https://www.google.com/maps/place/Cafe+"), k, F.lit("/data=!4m7!3m6%211s0xa"), k, F.lit(":0xb1!8m2!3d-33.25!4d149.5"),
        F.when(k % 5 == 0, "").when(k % 2 == 0, F.concat(F.lit("!16s"), F.replace(mid, F.lit("/"), F.lit("%2F")))).otherwise(
            F.concat(F.lit("!16z"), coded)), F.lit("?hl=en"))
    v = places.parse_place_link(href)
    return b.table(spark, sf, "customer").select(v["name"].alias("name"), v["cid"].alias("cid"), v["kgmid"].alias("kgmid"), v["lat"].alias("lat"), k.alias("k"))


# --- traffic -------------------------------------------------------------------------------------------


def _feed(spark, sf):
    base = b.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    u, k = F.col("user_id"), F.col("k")
    lat, lon = F.expr("CAST(-33.46D + (event_id * 37 % 900) / 10000D AS DOUBLE)"), F.expr("CAST(149.52D + (event_id * 53 % 1200) / 10000D AS DOUBLE)")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    jam = F.struct(F.lit(None).cast("string").alias("uuid"), u.alias("id"), (k % 6).alias("level"), (k * 5 - 1).alias("delay"),
                   F.lit(None).cast("double").alias("length"), F.lit(12.0).alias("speedKMH"), F.lit("Road").alias("street"), F.lit("Kelso").alias("city"),
                   F.when(k % 10 == 0, F.array().cast(f"array<{traffic.POINT}>")).otherwise(
                       F.array(point(lon, lat), point(lon + 0.004, lat), point(lon + 0.004, lat + 0.003))).alias("line"))
    kinds = F.array(*[F.lit(x) for x in [*vocab.ALERT_WEIGHTS, "OTHER"]])
    alert = F.struct(F.concat(F.lit("a"), u).alias("uuid"), F.lit(None).cast("bigint").alias("id"), F.get(kinds, k % 9).alias("type"),
                     F.when(k % 2 == 0, "SUB").otherwise("").alias("subtype"), F.when(k % 3 == 0, (k % 14).cast("double")).alias("reliability"),
                     F.lit(None).cast("int").alias("nThumbsUp"), F.lit("Road").alias("street"), F.lit("Kelso").alias("city"),
                     F.lit(None).cast("string").alias("reportDescription"), F.lit(None).cast("bigint").alias("pubMillis"), point(lon, lat).alias("location"))
    user = F.struct(F.lit(None).cast("string").alias("uuid"), F.when(k % 4 != 0, u.cast("string")).alias("id"),
                    F.when(k % 2 == 0, k / 10.0).alias("speed"), F.when(k % 2 == 1, k.cast("double")).alias("speedKMH"), lon.alias("x"), lat.alias("y"),
                    F.lit(None).cast("struct<x:double,y:double,latitude:double,longitude:double>").alias("location"))
    return base.select(F.date_format("ts", "yyyy-MM-dd").alias("pass_id"), F.col("event_id").cast("int").alias("response_no"),
                       F.array(jam).alias("jams"), F.array(alert).alias("alerts"), F.array(user).alias("users"))


def _box():
    return F.struct(*[F.lit(v).alias(k) for k, v in b.BOX.items()])


_IN = "lat BETWEEN -33.45 AND -33.38 AND lon BETWEEN 149.53 AND 149.63"
_FEED = f"""{b.OBS_SQL}, f AS (SELECT e.event_id, strftime(e.ts, '%Y-%m-%d') AS pass_id, e.user_id AS u, o.k, o.lat, o.lon FROM events e JOIN obs o ON o.obs_id = e.event_id),
jams AS (SELECT * FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY pass_id, u ORDER BY event_id) = 1) WHERE k % 10 <> 0),
alerts AS (SELECT * FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY pass_id, u ORDER BY event_id) = 1) WHERE {_IN}),
users AS (SELECT * FROM (SELECT *, CASE WHEN k % 2 = 1 THEN k::DOUBLE ELSE k::DOUBLE / 10 * 3.6::DOUBLE END AS speed FROM f
  QUALIFY k % 4 = 0 OR row_number() OVER (PARTITION BY pass_id, u, k % 4 = 0 ORDER BY event_id) = 1) WHERE {_IN}),
pts AS (SELECT pass_id, u, 0 AS pos, lat, lon FROM jams UNION ALL SELECT pass_id, u, 1, lat, lon + 0.004::DOUBLE FROM jams
  UNION ALL SELECT pass_id, u, 2, lat + 0.003::DOUBLE, lon + 0.004::DOUBLE FROM jams)"""


def _samples_sql(points: str, key: str, spacing: float) -> str:
    seg = haversine_sql("lat0", "lon0", "lat", "lon", "6371000")
    return f"""steps AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM {points} WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
segs AS (SELECT *, CASE WHEN lat0 IS NULL THEN 0 ELSE {seg} END AS seg FROM steps),
runs AS (SELECT *, sum(seg) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM segs),
samples AS (SELECT {key}, 0 AS k, lat, lon FROM runs WHERE lat0 IS NULL
  UNION ALL SELECT {key}, k, lat0 + (lat - lat0) * (k * {spacing}::DOUBLE - (upto - seg)) / seg, lon0 + (lon - lon0) * (k * {spacing}::DOUBLE - (upto - seg)) / seg
  FROM runs, LATERAL (SELECT unnest(generate_series((floor((upto - seg) / {spacing}::DOUBLE) + 1)::BIGINT, floor(upto / {spacing}::DOUBLE)::BIGINT)) AS k) t WHERE seg > 0)"""


_ALERT_KINDS = [*vocab.ALERT_WEIGHTS, "OTHER"]


@query("a8_traffic_observations", f"""
WITH {_FEED}, {_samples_sql('pts', 'pass_id, u', 100.0)}, long AS (SELECT pass_id, u, max(upto) AS metres FROM runs GROUP BY ALL)
SELECT pass_id, 'waze-jam' AS source, 'level-' || (j.k % 6) AS kind, round(s.lat, 5) AS lat, round(s.lon, 5) AS lon,
  round(CASE WHEN j.k * 5 - 1 = -1 THEN 1 ELSE greatest(least(5, j.k % 6)::DOUBLE / 5, least(greatest(j.k * 5 - 1, 0)::DOUBLE / 600, 1)) END, 4) AS weight,
  'Road/Kelso' AS place, 12 AS speed, (j.k * 5 - 1)::INTEGER AS delay, floor(metres + 0.5)::BIGINT AS metres, NULL AS type, NULL::DOUBLE AS reliability, NULL::INTEGER AS thumbs
FROM samples s JOIN jams j USING (pass_id, u) JOIN long USING (pass_id, u) WHERE s.lat BETWEEN -33.45 AND -33.38 AND s.lon BETWEEN 149.53 AND 149.63
UNION ALL SELECT pass_id, 'waze-alert', CASE WHEN k % 2 = 0 THEN 'SUB' ELSE [{', '.join(repr(x) for x in _ALERT_KINDS)}][k % 9 + 1] END, round(lat, 5), round(lon, 5),
  round([{', '.join(str(w) for w in [*vocab.ALERT_WEIGHTS.values(), 0.3])}][k % 9 + 1]::DOUBLE * (0.5 + 0.5 * least(CASE WHEN k % 3 = 0 THEN k % 14 ELSE 5 END / 10::DOUBLE, 1)), 4),
  'Road/Kelso', NULL, NULL, NULL, [{', '.join(repr(x) for x in _ALERT_KINDS)}][k % 9 + 1], CASE WHEN k % 3 = 0 THEN (k % 14)::DOUBLE END, 0 FROM alerts
UNION ALL SELECT pass_id, 'waze-users', CASE WHEN speed < 5 THEN 'stationary' ELSE 'moving' END, round(lat, 5), round(lon, 5), CASE WHEN speed < 5 THEN 1.5 ELSE 1 END,
  '', floor(speed + 0.5)::INTEGER, NULL, NULL, NULL, NULL, NULL FROM users""")
def traffic_rows(spark, sf):
    rows = traffic.feed_observations(_feed(spark, sf), _box())
    field = lambda name, kind: F.get_json_object("meta", f"$.{name}").cast(kind)
    return rows.select(
        "pass_id", "source", "kind", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("weight", 4).alias("weight"),
        F.concat_ws("/", field("street", "string"), field("city", "string")).alias("place"), field("speedKmh", "double").cast("int").alias("speed"),
        field("delaySec", "int").alias("delay"), field("lengthM", "bigint").alias("metres"), field("type", "string").alias("type"),
        field("reliability", "double").alias("reliability"), field("thumbsUp", "int").alias("thumbs"))


@query("d22_pass_counters", f"""
WITH {_FEED}, p AS (SELECT DISTINCT pass_id FROM f)
SELECT pass_id, (SELECT count(*) FROM jams j WHERE j.pass_id = p.pass_id) AS jams, (SELECT count(*) FROM alerts a WHERE a.pass_id = p.pass_id) AS alerts,
  (SELECT count(*) FROM users u WHERE u.pass_id = p.pass_id) AS users FROM p""")
def pass_counters(spark, sf):
    return traffic.pass_counters(_feed(spark, sf), _box())


_NEWEST = f"""{b.OBS_SQL}, recent AS (SELECT * FROM obs WHERE source IN ('waze-jam', 'waze-alert') AND ts >= TIMESTAMP '{b.AS_OF}' - INTERVAL 48 HOUR),
newest AS (SELECT * FROM recent QUALIFY ts = max(ts) OVER (PARTITION BY area))"""


def _newest(spark, sf):
    return traffic.newest_pass(b.observations(spark, sf), b.as_of(), 48, vocab.TRAFFIC_SOURCES)


@query("e2_newest_pass", f"WITH {_NEWEST} SELECT area, {time_sql('ts')} AS ts, obs_id, source FROM newest")
def newest(spark, sf):
    return _newest(spark, sf).select("area", time_text(F.col("ts")).alias("ts"), "obs_id", "source")


@query("e3_traffic_reports", f"""
WITH {b.OBS_SQL}, allt AS (SELECT * FROM obs WHERE source IN ('waze-jam', 'waze-alert'))
SELECT area, min(obs_id) AS obs_id, 'JAM' AS kind, street, k * 10 AS "lengthM" FROM allt WHERE source = 'waze-jam' GROUP BY area, ts, street, k
UNION ALL SELECT area, obs_id, kind, street, k * 10 FROM allt WHERE source = 'waze-alert'""")
def reports(spark, sf):
    rows = ob.parse_meta(b.observations(spark, sf))
    return traffic.snapshot_reports(rows).select("area", "obs_id", "kind", "street", F.col("lengthM").cast("int").alias("lengthM"))


@query("e3_snapshot_drivers", f"""
WITH {b.OBS_SQL} SELECT area, {time_sql('ts')} AS ts, obs_id, round(lat, 6) AS lat, round(lon, 6) AS lon, obs_id % 8 = 0 AS stationary FROM obs WHERE obs_id % 4 = 0""")
def drivers(spark, sf):
    seen = b.observations(spark, sf).withColumns({
        "kind": F.when(F.col("obs_id") % 8 == 0, "stationary").otherwise("moving"), "source": F.when(F.col("obs_id") % 4 == 0, "waze-users").otherwise("waze-jam")})
    return traffic.snapshot_drivers(seen).select(
        "area", time_text(F.col("ts")).alias("ts"), "obs_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "stationary")


_LINES = """pts AS (SELECT l_orderkey, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS pos,
  -33.46::DOUBLE + (l_partkey * 37 % 900)::DOUBLE / 10000 AS lat, 149.52::DOUBLE + (l_suppkey * 53 % 1200)::DOUBLE / 10000 AS lon FROM lineitem)"""


def _line_points(spark, sf):
    return b.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber * 100000000L + l_partkey * 1000 + l_suppkey AS pos",
        "CAST(-33.46D + (l_partkey * 37 % 900) / 10000D AS DOUBLE) AS lat", "CAST(149.52D + (l_suppkey * 53 % 1200) / 10000D AS DOUBLE) AS lon")


@query("e11_sampled_lines", f"""
WITH {_LINES}, {_samples_sql('pts', 'l_orderkey', 500.0)}
SELECT l_orderkey, count(*) AS n, round(max(lat), 5) AS max_lat, round(min(lon), 5) AS min_lon FROM samples GROUP BY l_orderkey""")
def sampled(spark, sf):
    rows = traffic.sample_lines(_line_points(spark, sf), ["l_orderkey"], 500.0)
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("lat"), 5).alias("max_lat"), F.round(F.min("lon"), 5).alias("min_lon"))


@query("h30_line_lengths", f"""
WITH {_LINES}, {_samples_sql('pts', 'l_orderkey', 500.0)} SELECT l_orderkey, round(max(upto), 2) AS length_m FROM runs GROUP BY l_orderkey""")
def lengths(spark, sf):
    return traffic.line_lengths(_line_points(spark, sf), ["l_orderkey"]).withColumn("length_m", F.round("length_m", 2))


# --- light and verdicts -------------------------------------------------------------------------------------

_SKY = """sky AS (SELECT o_orderkey, o_orderdate + to_hours((o_orderkey % 24)::INTEGER) AS seen, (o_custkey * 37 % 1600)::DOUBLE / 10 - 80 AS lat,
  (o_custkey * 53 % 3600)::DOUBLE / 10 - 180 AS lon FROM orders)"""


def _sky(spark, sf):
    return b.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "timestamp_seconds(unix_seconds(o_orderdate) + (o_orderkey % 24) * 3600) AS seen",
        "(o_custkey * 37 % 1600) / 10D - 80 AS lat", "(o_custkey * 53 % 3600) / 10D - 180 AS lon")


def _minute(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


@query("h20_sun_times", f"""
WITH {_SKY}, {sun_sql('sky', 'seen', 'lat', 'lon')}, l AS (SELECT *, floor((epoch_ms(sets) - epoch_ms(rise)) / 60000::DOUBLE + 0.5)::BIGINT AS mins FROM sun)
SELECT o_orderkey, strftime(rise, '%Y-%m-%d %H:%M') AS sunrise, strftime(sets, '%Y-%m-%d %H:%M') AS sunset,
  CASE WHEN rise IS NOT NULL AND g_rise IS NOT NULL THEN strftime(g_rise, '%Y-%m-%d %H:%M') END AS golden_end,
  CASE WHEN rise IS NOT NULL AND b_set IS NOT NULL THEN strftime(b_set, '%Y-%m-%d %H:%M') END AS blue_end,
  (mins // 60) || 'h ' || lpad((mins % 60)::VARCHAR, 2, '0') || 'm' AS day_length FROM l""")
def sun_times(spark, sf):
    return with_sun(_sky(spark, sf), "seen", "lat", "lon", "UTC").select(
        "o_orderkey", _minute(F.col("sun.sunrise")).alias("sunrise"), _minute(F.col("sun.sunset")).alias("sunset"),
        _minute(F.col("sun.golden_morning.end")).alias("golden_end"), _minute(F.col("sun.blue_evening.end")).alias("blue_end"), "sun.day_length")


@query("h21_moon", f"""
WITH {_SKY}, m AS (SELECT o_orderkey, (((epoch_ms(seen) / 86400000::DOUBLE + 2440587.5::DOUBLE - 2451550.26::DOUBLE) % 29.530588853::DOUBLE) + 29.530588853::DOUBLE) % 29.530588853::DOUBLE AS age FROM sky)
SELECT o_orderkey, floor(age * 10 + 0.5) / 10 AS age, floor((1 - cos(2 * pi() * (age / 29.530588853::DOUBLE))) / 2 * 100 + 0.5)::INTEGER AS illumination,
  CASE WHEN f < 0.02 OR f > 0.98 THEN 'New moon' WHEN f < 0.23 THEN 'Waxing crescent' WHEN f < 0.27 THEN 'First quarter' WHEN f < 0.48 THEN 'Waxing gibbous'
    WHEN f < 0.52 THEN 'Full moon' WHEN f < 0.73 THEN 'Waning gibbous' WHEN f < 0.77 THEN 'Last quarter' ELSE 'Waning crescent' END AS phase
FROM (SELECT *, age / 29.530588853::DOUBLE AS f FROM m)""")
def moons(spark, sf):
    return _sky(spark, sf).select("o_orderkey", moon(F.col("seen")).alias("m")).select("o_orderkey", "m.*")


@query("c15_a10_conditions", f"""
WITH places AS (SELECT n_name AS location, n_nationkey * 7 - 84::DOUBLE AS lat, n_nationkey * 14 - 170::DOUBLE AS lon, n_nationkey AS n FROM nation),
days AS (SELECT *, d, TIMESTAMP '{b.AS_OF}' + to_days(d::INTEGER) AS seen FROM places, range(2) t(d)), {sun_sql('days', 'seen', 'lat', 'lon')}
SELECT location, d::INTEGER AS day_no, strftime(seen, '%Y-%m-%d') AS date, strftime(rise, '%H:%M') AS sunrise,
  CASE WHEN n % 5 = 0 THEN NULL WHEN (n + d) % 3 = 0 THEN 'Clear' WHEN (n + d) % 3 = 1 THEN 'Mainly clear' ELSE 'Partly cloudy' END AS summary,
  CASE WHEN n % 5 <> 0 THEN (n + d)::DOUBLE END AS temp_max, CASE WHEN n % 5 = 0 THEN '' WHEN n * 4 < 15 THEN 'clear — flat sky' WHEN n * 4 < 40 THEN 'some cloud — good'
    WHEN n * 4 < 75 THEN 'broken cloud — best' ELSE 'overcast — soft light' END AS cloud FROM sun""")
def conditions(spark, sf):
    n = F.col("n_nationkey")
    nation = b.table(spark, sf, "nation")
    locations = nation.select(F.col("n_name").alias("location"), (n * 7 - F.lit(84.0)).alias("lat"), (n * 14 - F.lit(170.0)).alias("lon"))
    two = lambda c: F.array(c(0), c(1))
    daily = F.struct(
        F.array(F.lit("2024-01-31"), F.lit("2024-02-01")).alias("time"), two(lambda d: ((n + d) % 3).cast("int")).alias("weather_code"),
        two(lambda d: (n + d).cast("double")).alias("temperature_2m_max"), two(lambda d: (n * 4).cast("double")).alias("cloud_cover_mean"))
    text_rows = nation.filter(n % 5 != 0).select(F.to_json(F.struct(F.col("n_name").alias("location"), daily.alias("daily"))).alias("json"))
    parsed = text_rows.select(F.from_json("json", forecast.FORECAST_SCHEMA.replace("\n", " ")).alias("p")).select("p.*")
    rows = cond.conditions(locations, forecast.daily_forecast(parsed), b.as_of(), "UTC")
    return rows.select("location", "day_no", "date", F.date_format("sun.sunrise", "HH:mm").alias("sunrise"), "summary", "temp_max",
                       shoot.cloud_note(F.col("cloud_cover")).alias("cloud"))


_SHOTS = """shots AS (SELECT event_id, least(100, floor(value))::INTEGER AS busy, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS typical,
  CASE event_type WHEN 'view' THEN 'day' WHEN 'click' THEN 'golden' WHEN 'signup' THEN 'blue' WHEN 'purchase' THEN 'night' END AS light FROM events)"""


@query("h23_h24_verdicts", f"""
WITH {_SHOTS}, s AS (SELECT *, {score_sql('busy', 'typical', 'light')} AS s FROM shots)
SELECT event_id, round(s, 4) AS score, {label_sql('s')} AS label, {why_sql('busy', 'typical', 'light', 'false')} AS why FROM s""")
def verdicts(spark, sf):
    kind = F.col("event_type")
    light = F.when(kind == "view", "day").when(kind == "click", "golden").when(kind == "signup", "blue").when(kind == "purchase", "night")
    rows = b.table(spark, sf, "events").select(
        "event_id", F.least(F.lit(100), F.floor("value")).cast("int").alias("busy"),
        F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k").cast("int")).alias("typical"), light.alias("light"))
    v = shoot.verdict(F.col("busy"), F.col("typical"), F.col("light"), F.lit(False))
    return rows.select("event_id", v.alias("v")).select("event_id", F.round("v.score", 4).alias("score"), "v.label", "v.why")


# --- geometry, areas, export -----------------------------------------------------------------------------------


@query("h28_h29_area_tiles", """
WITH s AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 1200)::DOUBLE / 10 - 60 AS lat, (s_suppkey * 53 % 3000)::DOUBLE / 10 - 150 AS lng, CASE WHEN s_suppkey % 4 = 0 THEN 5.5::DOUBLE ELSE (s_suppkey % 20 + 1)::DOUBLE END AS r FROM supplier),
bx AS (SELECT *, lat - r * 1000 / 111320::DOUBLE AS south, lat + r * 1000 / 111320::DOUBLE AS north,
  lng - r * 1000 / (111320::DOUBLE * cos(radians(lat))) AS west, lng + r * 1000 / (111320::DOUBLE * cos(radians(lat))) AS east FROM s),
n AS (SELECT *, greatest(1, ceil((north - south) / 0.06::DOUBLE))::BIGINT AS tr, greatest(1, ceil((east - west) / 0.06::DOUBLE))::BIGINT AS tc FROM bx)
SELECT 'supplier-' || lpad(k::VARCHAR, 9, '0') AS slug, tr * tc AS tiles, round(south, 6) AS south, round(east, 6) AS east,
  greatest(1, ceil((north - south) / (150 / 111320::DOUBLE)))::BIGINT AS n_rows FROM n""")
def area_tiles(spark, sf):
    k = F.col("s_suppkey")
    settings = b.table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), ((k * 37 % 1200) / 10.0 - 60).alias("lat"), ((k * 53 % 3000) / 10.0 - 150).alias("lng"),
        F.when(k % 4 != 0, (k % 20 + 1).cast("double")).alias("radius_km"), F.lit(None).cast("double").alias("cell_metres"),
        F.lit(None).cast("double").alias("kernel_metres"), F.lit(None).cast("struct<south:double,west:double,north:double,east:double>").alias("bbox"))
    areas = grid.area_dimension(settings)
    tiles = areas.select("slug", "bbox", geo.grid_of(F.col("bbox"), F.col("cell_metres")).alias("g"), F.explode(geo.box_tiles(F.col("bbox"), 0.06)).alias("t"))
    return tiles.groupBy("slug", "bbox", "g").agg(F.count(F.lit(1)).alias("tiles")).select(
        "slug", "tiles", F.round("bbox.south", 6).alias("south"), F.round("bbox.east", 6).alias("east"), "g.n_rows")


@query("h31_slugs", """
WITH names AS (SELECT p_name || ' ' || p_brand AS name FROM part UNION SELECT url FROM pages)
SELECT name, CASE WHEN s = '' THEN 'area' ELSE s END AS slug FROM
  (SELECT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM names)""")
def slugs(spark, sf):
    names = b.table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).union(b.table(spark, sf, "pages").select("url")).distinct()
    return names.select("name", text.slug(F.col("name")).alias("slug"))


def _esc(expr: str) -> str:
    return f"regexp_replace(replace(replace(replace({expr}, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), '\\r?\\n', '\\\\n', 'g')"


_ENTRY = f"""array_to_string(list_filter([
  'BEGIN:VEVENT', 'UID:' || group_key || '@vantage', 'DTSTAMP:20240212T060000Z', 'DTSTART:' || strftime(start_ts, '%Y%m%dT%H%M%SZ'),
  'DTEND:' || strftime(coalesce(end_ts, start_ts + INTERVAL 2 HOUR), '%Y%m%dT%H%M%SZ'), 'SUMMARY:' || {_esc('title')},
  'DESCRIPTION:' || {_esc("concat_ws(chr(10), nullif(description, ''), nullif(url, ''))")},
  'LOCATION:' || {_esc("concat_ws(', ', nullif(venue_name, ''), nullif(address, ''))")},
  'CATEGORIES:' || {_esc("nullif(category, '')")}, 'GEO:' || lat || ';' || lng, 'URL:' || nullif(url, ''), 'END:VEVENT'
  ], lambda x: x IS NOT NULL), chr(13) || chr(10)) || chr(13) || chr(10)"""


@query("a17_calendar_entries", f"""
WITH {_HEADS}, e AS (SELECT group_key, {_ENTRY} AS entry FROM heads)
SELECT group_key, md5(entry) AS entry_md5, true AS short_lines FROM e""")
def calendar_entries(spark, sf):
    rows = ics.entry(_heads(spark, sf), b.listing_as_of(), description_chars=None)
    short = F.array_max(F.transform(F.split("entry", "\r\n"), lambda x: F.octet_length(x))) <= 75
    return rows.select("group_key", F.md5(F.replace("entry", F.lit("\r\n "), F.lit(""))).alias("entry_md5"), short.alias("short_lines"))


@query("a17_calendar_files", f"""
WITH {_HEADS}, e AS (SELECT *, strftime(start_ts, '%Y-%m') AS month, {_ENTRY} AS entry FROM heads WHERE NOT hidden),
files AS (SELECT category, month, count(*) AS n, concat_ws(' - ', 'Events', nullif(category, '')) AS name FROM e GROUP BY ALL),
rows_ AS (
  SELECT category, month, 1 AS part, row_number() OVER (PARTITION BY category, month ORDER BY start_ts, group_key) AS position, entry AS text FROM e
  UNION ALL SELECT category, month, 2, n + 1, 'END:VCALENDAR' || chr(13) || chr(10) FROM files
  UNION ALL SELECT category, month, 0, 0, array_to_string([
  'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//vantage//EN', 'CALSCALE:GREGORIAN', 'X-WR-CALNAME:' || {_esc('name')}, 'NAME:' || {_esc('name')},
  'REFRESH-INTERVAL;VALUE=DURATION:PT2H', 'X-PUBLISHED-TTL:PT2H', 'X-WR-CALDESC:' || n || ' events', 'DESCRIPTION:' || n || ' events', ''
  ], chr(13) || chr(10)) FROM files)
SELECT category, month, part, position, md5(text) AS text_md5 FROM rows_""")
def calendar_files(spark, sf):
    rows = ics.entry(views.feed_events(_heads(spark, sf), b.listing_as_of()), b.listing_as_of(), description_chars=None)
    lines = ics.calendar_lines(ics.calendar_rows(rows, "category"), "category")
    return lines.select("category", "month", "part", "position", F.md5(F.replace("text", F.lit("\r\n "), F.lit(""))).alias("text_md5"))


@query("d24_bounds", f"""
WITH {_HEADS}, {b.VENUE_SQL}, boxes AS (
  SELECT lat AS south, lng AS west, lat AS north, lng AS east FROM heads WHERE NOT hidden AND lat IS NOT NULL AND lng IS NOT NULL
  UNION ALL SELECT lat - 0.01, lon - 0.02, lat + 0.01, lon + 0.02 FROM venues)
SELECT round(min(south), 6) AS south, round(min(west), 6) AS west, round(max(north), 6) AS north, round(max(east), 6) AS east FROM boxes""")
def event_bounds(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    cells = b.venues(spark, sf).select((lat - 0.01).alias("south"), (lat + 0.01).alias("north"), (lon - 0.02).alias("west"), (lon + 0.02).alias("east"))
    return views.bounds(cells, _heads(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")])


@query("h25_h26_traffic_weights", f"""
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, round(CASE WHEN k * 9 - 1 = -1 THEN 1 ELSE greatest(least(5, k % 8)::DOUBLE / 5, least(greatest(k * 9 - 1, 0)::DOUBLE / 600, 1)) END, 4) AS severity,
  round([{', '.join(str(w) for w in [*vocab.ALERT_WEIGHTS.values(), 0.3])}][k % 9 + 1]::DOUBLE * (0.5 + 0.5 * least(CASE WHEN k % 3 = 0 THEN k % 14 ELSE 5 END / 10::DOUBLE, 1)), 4) AS weight FROM e""")
def traffic_weights(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.array(*[F.lit(x) for x in _ALERT_KINDS])
    return b.table(spark, sf, "events").select(
        "event_id", F.round(shoot.jam_severity(k % 8, k * 9 - 1), 4).alias("severity"),
        F.round(shoot.alert_weight(F.get(kinds, k % 9), F.when(k % 3 == 0, (k % 14).cast("double"))), 4).alias("weight"))


@query("b13_h32_picked_areas", """
SELECT s_name AS name, 'supplier-' || lpad(s_suppkey::VARCHAR, 9, '0') AS slug, CASE WHEN s_suppkey % 3 = 0 THEN 90 ELSE 150 END::DOUBLE AS cell_metres,
  300::DOUBLE AS kernel_metres FROM supplier WHERE s_suppkey % 5 <> 0 AND s_name IN ('Supplier#000000003', 'Supplier#000000004', 'Supplier#000000005')""")
def picked_areas(spark, sf):
    k = F.col("s_suppkey")
    settings = b.table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.when(k % 5 != 0, F.lit(-33.4)).alias("lat"), F.lit(149.5).alias("lng"),
        F.lit(None).cast("double").alias("radius_km"), F.when(k % 3 == 0, 90.0).alias("cell_metres"), F.lit(None).cast("double").alias("kernel_metres"),
        F.lit(None).cast("struct<south:double,west:double,north:double,east:double>").alias("bbox"))
    chosen = grid.pick_areas(grid.area_dimension(settings), [" supplier-000000003", "SUPPLIER#000000004", "supplier-000000005", ""])
    return chosen.drop("bbox")


@query("b4_nearby_listings", f"""
WITH {b.LISTING_SQL} SELECT source, count(*) AS n FROM listing
WHERE lat IS NULL OR {haversine_sql('-33.4193::DOUBLE', '149.5775::DOUBLE', 'lat', 'lng')} <= 2.5::DOUBLE * 1.5 GROUP BY source""")
def nearby(spark, sf):
    return structured.nearby_only(b.listings(spark, sf), b.AREAS[0]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("g5_text_links", f"""
WITH {_HEADS}, told AS (SELECT DISTINCT group_key, regexp_replace(u, '[.,;:!?)\\]]+$', '') AS url FROM heads,
  unnest(regexp_extract_all(description || ' ' || url || ' https://extra.example.org/' || member_count || '.', 'https?://[^\\s"''<>)\\]]+')) t(u))
SELECT group_key, url FROM told WHERE url NOT IN (SELECT url FROM grouped WHERE grouped.group_key = told.group_key)""")
def text_links(spark, sf):
    rows = b.grouped_listings(spark, sf)
    heads = merged.merged_heads(rows).withColumn("description", F.concat(
        "description", F.lit(" "), "url", F.lit(" https://extra.example.org/"), F.col("member_count").cast("string"), F.lit(".")))
    links = views.event_links(heads, merged.merged_members(rows))
    return links.filter(~F.col("from_source")).select("group_key", "url")
