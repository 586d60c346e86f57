"""Merged events as calendar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.text import plain_number
from vantage.operators.ranking import sorted_positions

CRLF = "\r\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(";"), F.lit("\\;"))
    out = F.replace(out, F.lit(","), F.lit("\\,"))
    return F.regexp_replace(out, "\r?\n", r"\\n")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def fold(line: Column) -> Column:
    """Break a line at 75 octets, 74 on continuations, never inside a character.

    The line is read as one character per octet, so a single pattern cuts it:
    the longest piece that is not followed by a continuation octet.
    """
    octets = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    pieces = F.regexp_extract_all(octets, F.lit("(?s)((?:^.{1,75}|.{1,74})(?![\\x80-\\xbf]))"), 0)
    folded = F.decode(F.encode(F.array_join(pieces, CRLF + " "), "ISO-8859-1"), "UTF-8")
    return F.when(F.octet_length(line) <= 75, line).otherwise(folded)


def entry(events: DataFrame, as_of: Column, domain: str = "vantage", description_chars: int | None = None) -> DataFrame:
    """Add ``entry``: the folded VEVENT text of each event, every line ending in CRLF."""
    c = F.col
    end = F.coalesce("end_ts", c("start_ts") + F.make_dt_interval(hours=F.lit(2)))
    described = F.substring("description", 1, description_chars) if description_chars else c("description")
    filled = lambda x: F.when(x != "", x)
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), c("group_key"), F.lit(f"@{domain}")),
        F.concat(F.lit("DTSTAMP:"), stamp(as_of)), F.concat(F.lit("DTSTART:"), stamp(c("start_ts"))),
        F.concat(F.lit("DTEND:"), stamp(end)), F.concat(F.lit("SUMMARY:"), escape(c("title"))),
        F.concat(F.lit("DESCRIPTION:"), escape(F.concat_ws("\n", filled(described), filled(c("url"))))),
        F.concat(F.lit("LOCATION:"), escape(F.concat_ws(", ", filled(c("venue_name")), filled(c("address"))))),
        F.concat(F.lit("CATEGORIES:"), escape(filled(c("category")))),
        F.concat(F.lit("GEO:"), plain_number(c("lat")), F.lit(";"), plain_number(c("lng"))),
        F.concat(F.lit("URL:"), filled(c("url"))), F.lit("END:VEVENT"),
    )
    present = F.filter(lines, lambda x: x.isNotNull())
    return events.withColumn("entry", F.concat(F.array_join(F.transform(present, fold), CRLF), F.lit(CRLF)))


def header(name: Column, description: Column, product: str = "-//vantage//EN") -> Column:
    filled = F.when(description != "", escape(description))
    lines = F.array(
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("CALSCALE:GREGORIAN"),
        F.concat(F.lit("X-WR-CALNAME:"), escape(name)), F.concat(F.lit("NAME:"), escape(name)),
        F.lit("REFRESH-INTERVAL;VALUE=DURATION:PT2H"), F.lit("X-PUBLISHED-TTL:PT2H"),
        F.concat(F.lit("X-WR-CALDESC:"), filled), F.concat(F.lit("DESCRIPTION:"), filled),
    )
    present = F.filter(lines, lambda x: x.isNotNull())
    return F.concat(F.array_join(F.transform(present, fold), CRLF), F.lit(CRLF))


def calendar_rows(entries: DataFrame, feed: str, title: str = "Events") -> DataFrame:
    """(feed, month, part, start_ts, group_key, text): the rows of complete calendars, one calendar for each month of a feed.

    Part 0 is the head, 1 the entries, 2 the end; in the order of all columns but the text they make the file. A calendar of any
    size is rows of a table, never one value. An event's file depends on its own start alone, so it never moves when others
    come or go.
    """
    dated = entries.withColumn("month", F.date_format("start_ts", "yyyy-MM"))
    name = F.concat_ws(" - ", F.lit(title), F.when(F.col(feed) != "", F.col(feed)))
    about = F.concat(F.col("_events").cast("string"), F.lit(" events"))
    ends = F.array(F.struct(F.lit(0).alias("part"), header(name, about).alias("text")), F.struct(F.lit(2).alias("part"), F.lit("END:VCALENDAR" + CRLF).alias("text")))
    edges = dated.groupBy(feed, "month").agg(F.count(F.lit(1)).alias("_events")).select(feed, "month", F.inline(ends))
    body = dated.select(feed, "month", F.lit(1).alias("part"), "start_ts", "group_key", F.col("entry").alias("text"))
    return body.unionByName(edges, allowMissingColumns=True)


def _order(feed: str) -> list[str]:
    return [feed, "month", "part", "start_ts", "group_key"]


def calendar_lines(rows: DataFrame, feed: str) -> DataFrame:
    """Add ``position``, the place of a row in its own file from 0 on."""
    placed = sorted_positions(rows.orderBy(*_order(feed)), "_place")
    first = placed.filter("part = 0").select(feed, "month", F.col("_place").alias("_first"))
    return placed.join(first, [feed, "month"]).withColumn("position", F.col("_place") - F.col("_first")).drop("_place", "_first")


def write_calendars(rows: DataFrame, feed: str, path: str) -> None:
    """Text files under feed=.../month=...; every line, the last one too, ends in CRLF.

    The sorted rows are cut into even ranges, so a crowded month is written by several tasks: its calendar is its files in the
    order of their names.
    """
    even = rows.repartitionByRange(*_order(feed)).sortWithinPartitions(*_order(feed))
    even.select(feed, "month", F.regexp_replace("text", "\r\n$", "").alias("text")).write.mode("overwrite").option(
        "lineSep", CRLF).partitionBy(feed, "month").text(path)
