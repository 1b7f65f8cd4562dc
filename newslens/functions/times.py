"""Time spans, time stamps and bucket widths."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "%Y%m%dT%H%M%SZ"
STAMP_SPARK = "yyyyMMdd'T'HHmmss'Z'"

# Names of the units of a time span.
UNITS = {
    "min": ("min", "mins", "minutes"),
    "h": ("h", "hr", "hour", "hours"),
    "d": ("d", "day", "days"),
    "w": ("w", "wk", "week", "weeks"),
    "m": ("m", "mo", "month", "months"),
}
#: Names that the command line accepts besides.
MORE_UNITS = {"min": ("minute",), "y": ("y", "yr", "year", "years")}

#: Least and greatest spans of the services; a month counts as 31 days here.
SERVICE_WINDOW = {"doc": timedelta(days=93), "context": timedelta(hours=72), "geo": timedelta(days=7)}


def parse_timespan(value: object) -> str:
    """``7d``, ``2w``, ``1m``, ``24h`` or ``15min`` from what a user writes; a bare number means days, and what is not understood stays as it is."""
    text = str(value).strip().lower()
    found = re.match(r"(\d+)\s*([a-z]*)\Z", text)
    if not found:
        return text
    number, unit = found.groups()
    names = {name: code for code, all_names in UNITS.items() for name in all_names}
    if not unit:
        return f"{number}d"
    return f"{number}{names[unit]}" if unit in names else text


def interval_sql(span: str) -> str:
    """A span as an SQL interval. A month is a calendar month."""
    found = re.fullmatch(r"(\d+)\s*([a-z]+)", parse_timespan(span))
    names = {name: code for table in (UNITS, MORE_UNITS) for code, all_names in table.items() for name in all_names}
    if not found or found[2] not in names:
        raise ValueError(f"not a time span: {span!r}")
    word = {"min": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "m": "MONTH", "y": "YEAR"}[names[found[2]]]
    return f"INTERVAL {int(found[1])} {word}"


def seconds(span: str) -> int:
    """Length of a span, with 30 days to a month and 365 to a year."""
    number, word = interval_sql(span).split()[1:]
    return int(number) * {"MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800, "MONTH": 2592000, "YEAR": 31536000}[word]


def effective_timespan(timespan: str | None, days: int | None) -> str:
    """A given time span goes before days; without either, a week."""
    if timespan:
        return parse_timespan(timespan)
    return "7d" if days is None else f"{days}d"


@dataclass(frozen=True)
class TimeWindow:
    """From ``start`` to ``end``, both included; a missing bound is open."""

    start: str | None
    end: str | None

    @staticmethod
    def absolute(start: str | None, end: str | None) -> TimeWindow:
        """From bounds written YYYYMMDDHHMMSS."""
        return TimeWindow(*(datetime.strptime(x, "%Y%m%d%H%M%S").isoformat(" ") if x else None for x in (start, end)))

    def holds(self, ts: Column) -> Column:
        out = F.lit(True) if self.start is None else ts >= F.lit(self.start).cast("timestamp_ntz")
        return out if self.end is None else out & (ts <= F.lit(self.end).cast("timestamp_ntz"))

    def length(self) -> timedelta | None:
        """None if it is open."""
        return datetime.fromisoformat(self.end) - datetime.fromisoformat(self.start) if self.start and self.end else None


def before(now: str, span: str) -> str:
    """The time that is a span before another; a month counts as 30 days."""
    return (datetime.fromisoformat(now) - timedelta(seconds=seconds(span))).isoformat(" ")


def relative(ts: Column, span: str, now: str) -> Column:
    """Within ``span`` before ``now``, which is always given, so that a query can be run again."""
    then = F.lit(now).cast("timestamp_ntz")
    return (ts >= then - F.expr(interval_sql(span))) & (ts <= then)


def clamped(span: str, service: str) -> str:
    """A span cut to what a service offers."""
    most = SERVICE_WINDOW.get(service)
    return span if most is None or seconds(span) <= most.total_seconds() else f"{int(most.total_seconds() // 3600)}h"


def resolution(length: timedelta | int) -> str:
    """Width of a timeline's buckets: under 72 hours quarter hours, to a week hours, beyond days."""
    s = length.total_seconds() if isinstance(length, timedelta) else length
    return "15min" if s < 72 * 3600 else "hour" if s <= 7 * 86400 else "day"


def bucket(ts: Column, width: str) -> Column:
    """Start of the bucket: ``15min``, ``hour``, ``day``, ``week``, ``month`` or ``year``."""
    if width == "15min":
        return F.window(ts, "15 minutes")["start"].cast("timestamp_ntz")
    return F.date_trunc(width, ts).cast("timestamp_ntz")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP_SPARK)


def parse_stamp(text: Column) -> Column:
    """A time stamp as the services write it; null where it isn't one."""
    exact = F.when(text.rlike(r"^\d{8}T\d{6}Z$"), text)
    return F.try_to_timestamp(exact, F.lit(STAMP_SPARK)).cast("timestamp_ntz")


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def day_of_stamp(text: Column) -> Column:
    """YYYY-MM-DD from a time stamp; a short text stays."""
    d = F.left(text, F.lit(8))
    return F.when(F.length(text) >= 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(text)


def int_date(value: Column) -> Column:
    """A date from a whole number YYYYMMDD."""
    return F.to_date(value.cast("string"), "yyyyMMdd")


def fortnight(ts: Column) -> Column:
    """Fourteen days after the start of the month."""
    return F.date_trunc("month", ts).cast("timestamp_ntz") + F.expr("INTERVAL 14 DAYS")
