"""Time helpers. The session zone is UTC; every local reading names its zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage.functions.text import trim_all


# Forms of a day, and of a clock time after it, that pages write beside ISO 8601: each part in brackets may be absent.
WRITTEN_TIME = (
    "[yyyy-M-d][yyyy/M/d][M/d/yyyy][MMMM d, yyyy][MMM d, yyyy][MMM d yyyy][d MMM yyyy][d MMMM yyyy]"
    "[ h:mm a][ H:mm[:ss][ Z]]"
)


def parse_time(text: Column) -> Column:
    """ISO-like, RFC 2822 or written-out text to timestamp, null when it is not a time.

    A text without a day is not a time: nothing is taken from the clock of the run.
    """
    # Offsets may lack their colon, and a time with an offset its seconds.
    iso_like = F.regexp_replace(text, r"(\d[+-]\d{2})(\d{2})\s*$", "$1:$2")
    iso_like = F.regexp_replace(iso_like, r"([T ]\d{1,2}:\d{2})([+-])", "$1:00$2")
    dated = F.when(text.rlike(r"^\s*\d{4}(-\d{1,2}){0,2}([T ]\d.*)?$"), iso_like.try_cast("timestamp"))
    # The weekday name is redundant, and a named zone here can only be UTC.
    plain = F.regexp_replace(F.regexp_replace(trim_all(text), "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +", ""), " ?(GMT|UTC|Z)$", " +0000")
    clock = F.regexp_replace(F.regexp_replace(plain, "(?i) ?am$", " AM"), "(?i) ?pm$", " PM")
    written = F.try_to_timestamp(clock, F.lit(WRITTEN_TIME))
    return F.coalesce(dated, F.when(text.rlike(r"\d{4}") & text.rlike(r"^\s*[A-Z]|\d[/ -]"), written))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_date(ts: Column) -> Column:
    return F.to_date(ts)


def local(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(local(ts, tz))


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(local(ts, tz))


def weekday(day: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(day) - 1


def local_weekday(ts: Column, tz: str) -> Column:
    return weekday(local(ts, tz))


def half_up(x: Column) -> Column:
    """Round half towards positive infinity, as whole number."""
    return F.floor(x + 0.5)


def date_window(chip: str, as_of: Column, tz: str) -> tuple[Column, Column] | None:
    """Half-open [start, end) in UTC for today, weekend, week or month; None for all."""
    today = local_date(as_of, tz)
    if chip == "today":
        start, end = today, F.date_add(today, 1)
    elif chip == "weekend":
        dow = weekday(today)
        saturday = F.date_add(today, F.when(dow == 0, F.lit(-1)).otherwise(6 - dow))
        start = F.when(dow.isin(0, 6), today).otherwise(saturday)
        end = F.date_add(saturday, 2)
    elif chip == "week":
        start, end = today, F.date_add(today, 7)
    elif chip == "month":
        # One calendar month on; a day the next month lacks runs over into the one after.
        first_next = F.add_months(F.trunc(today, "month"), 1)
        start, end = today, F.date_add(first_next, F.dayofmonth(today) - 1)
    else:
        return None
    as_utc = lambda d: F.to_utc_timestamp(d.cast("timestamp"), tz)
    return as_utc(start), as_utc(end)
