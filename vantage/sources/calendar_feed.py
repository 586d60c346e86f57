"""Calendar files to raw listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions.times import iso
from vantage.sources.ticketing import leading_number, raw_row


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(feed_url, text) of landed calendar files."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("feed_url"), F.col("value").alias("text")
    )


def _value(block: Column, name: str) -> Column:
    """Raw value of a property, null when the block lacks it."""
    line = F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\r\n]*)?:(.*?)\r?$", 1)
    return F.when(block.rlike(rf"(?m)^{name}[;:]"), line)


def _unescape(c: Column) -> Column:
    # One backslash stands aside while the other escapes are read.
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0001"))
    out = F.regexp_replace(out, r"\\[nN]", "\n")
    out = F.regexp_replace(out, r"\\([;,:])", "$1")
    return F.replace(out, F.lit("\u0001"), F.lit("\\"))


def _instant(block: Column, name: str, tz: str) -> Column:
    """UTC instant of a date property: trailing Z, TZID or floating (read in ``tz``)."""
    raw = _value(block, name)
    zone = F.regexp_extract(block, rf"(?m)^{name}[^:\r\n]*;TZID=\"?([^;:\"\r\n]+)", 1)
    shape = F.when(raw.rlike("^[0-9]{8}T[0-9]{6}Z?$"), F.try_to_timestamp(
        F.substring(raw, 1, 15), F.lit("yyyyMMdd'T'HHmmss")
    )).when(raw.rlike("^[0-9]{8}$"), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))
    known = zone.rlike("^[A-Za-z_]+(/[A-Za-z_+-]+)+$")
    return F.when(raw.endswith("Z"), shape).otherwise(
        F.to_utc_timestamp(shape, F.when(known, zone).otherwise(F.lit(tz)))
    )


def _length(block: Column) -> Column:
    """The DURATION of an event, null when it has none."""
    raw = _value(block, "DURATION")
    part = lambda unit: F.coalesce(F.regexp_extract(raw, rf"([0-9]+){unit}", 1).try_cast("int"), F.lit(0))
    seconds = part("W") * 604_800 + part("D") * 86_400 + part("H") * 3_600 + part("(?=M)") * 60 + part("S")
    return F.when(raw.rlike(r"^\+?P(?=[0-9T])"), F.make_dt_interval(secs=seconds))


def horizon(as_of: Column, months: int = 6) -> Column:
    """The same day and time some months on; a day that month lacks runs over into the next."""
    first = F.add_months(F.trunc(as_of, "month"), months)
    return F.date_add(first, F.dayofmonth(as_of) - 1).cast("timestamp") + (as_of - F.date_trunc("day", as_of))


def calendar_events(feeds: DataFrame, as_of: Column, tz: str = "UTC") -> DataFrame:
    """Listings of (feed_url, feed_name, text) starting in (as_of - 24 h, as_of + 6 months].

    Of events that share a UID within a feed the last one counts.
    """
    unfolded = F.regexp_replace("text", "\r?\n[ \t]", "")
    blocks = F.filter(F.split(unfolded, "BEGIN:VEVENT"), lambda _b, i: i > 0)
    block = F.substring_index(F.col("_block"), "END:VEVENT", 1)
    rows = feeds.select("feed_url", "feed_name", F.posexplode(blocks).alias("_pos", "_block")).withColumn("b", block).drop("_block")
    # Alarms inside an event carry their own properties.
    rows = rows.withColumn("b", F.regexp_replace("b", r"(?s)BEGIN:VALARM.*?END:VALARM", ""))
    b = F.col("b")
    own = F.coalesce(_value(b, "UID"), F.concat(F.lit("\u0001"), F.col("_pos").cast("string")))
    rows = rows.groupBy("feed_url", own.alias("_own")).agg(
        F.max_by(F.struct("feed_name", "b"), "_pos").alias("_last")).select("feed_url", "_last.feed_name", "_last.b")
    rows = rows.withColumn("_start", _instant(b, "DTSTART", tz)).withColumns({
        "_end": F.coalesce(_instant(b, "DTEND", tz), F.col("_start") + _length(b)),
        "_summary": _unescape(_value(b, "SUMMARY")), "_geo": _value(b, "GEO"), "_uid": _value(b, "UID"),
    })
    start = F.col("_start")
    rows = rows.filter(
        (start <= horizon(as_of)) & (start >= as_of - F.make_dt_interval(hours=F.lit(24)))
    )
    summary = F.coalesce("_summary", F.lit("undefined"))
    uid = F.coalesce("_uid", F.sha1(F.concat_ws("|", "feed_url", summary, iso(start))))
    coordinate = lambda i: leading_number(F.try_element_at(F.split("_geo", ";"), F.lit(i)))
    return rows.select(*raw_row(
        source=F.lit("ical"), source_id=F.concat(F.substring(F.sha1("feed_url"), 1, 8), F.lit(":"), uid),
        title=F.coalesce("_summary", F.lit("Untitled event")),
        description=F.coalesce(_unescape(_value(b, "DESCRIPTION")), F.lit("")), start_time=iso(start),
        end_time=iso(F.col("_end")), venue_name=F.col("feed_name"),
        address=F.coalesce(_unescape(_value(b, "LOCATION")), F.lit("")), lat=coordinate(1), lng=coordinate(2),
        url=F.coalesce(_value(b, "URL"), F.lit("")), category=F.lit("Community"),
    ))
