"""Dates and times: native parsers that yield NULL instead of raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import LOCAL_TZ

#: How far behind ``seen_at`` a claimed publish time may lie in the future.
MAX_FUTURE_HOURS = 2


def effective_at(published_at: Column, seen_at: Column) -> Column:
    """Publisher time only where it is not later than first sight; else first sight. Derived on read, never stored."""
    return F.least(F.coalesce(published_at, seen_at), seen_at)


def local_time(ts_utc: Column, tz: str = LOCAL_TZ) -> Column:
    """Wall clock in ``tz`` of a UTC ``timestamp_ntz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts_utc)


def local_day(ts_utc: Column, tz: str = LOCAL_TZ) -> Column:
    return local_time(ts_utc, tz).cast("date")


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("long"))


def listing_datetime(text: Column, tz: str = LOCAL_TZ) -> Column:
    """``yyyy/M/d H:m:s``, ``yyyy/M/d H:m`` or ``yyyy-M-d H:m:s`` in local wall time, as an instant."""
    forms = ("yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy-M-d H:m:s")
    return F.to_utc_timestamp(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]), tz)


_ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def feed_datetime(text: Column) -> Column:
    """RFC 822 (weekday optional, zone names of that RFC) or ISO 8601 as an instant; zoneless values are UTC."""
    t = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},?\s+(?=\d)", ""))
    zoned = t
    for name, offset in _ZONES.items():
        zoned = F.regexp_replace(zoned, rf"\s+{name}$", f" {offset}")
    forms = [(zoned, "d MMM yyyy H:mm:ss Z"), (zoned, "d MMM yyyy H:mm Z"), (zoned, "d MMM yyyy H:mm:ss"), (zoned, "d MMM yy H:mm:ss Z")]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for c, f in forms], F.when(t.rlike(r"^\d{4}-\d\d?-\d\d?"), t.try_cast("timestamp")))


def free_datetime(text: Column, offset_is_wrong: Column | None = None, tz: str = LOCAL_TZ) -> Column:
    """Page-supplied time as an instant: zoneless means local; with ``offset_is_wrong`` the clock is kept and the offset dropped."""
    t = F.trim(text)
    zone = r"\s*(?:Z|[+-]\d{2}:?\d{2}|GMT|UTC)$"
    clock = F.trim(F.regexp_replace(F.regexp_replace(t, zone, ""), r"^\s*[A-Za-z]{3,9},?\s+(?=\d)", ""))
    iso = F.regexp_replace(F.regexp_replace(clock, "/", "-"), "T", " ")
    naive = F.coalesce(
        F.when(iso.rlike(r"^\d{4}-\d\d?-\d\d?"), iso.try_cast("timestamp_ntz")),
        F.try_to_timestamp(clock, F.lit("d MMM yyyy H:mm:ss")).cast("timestamp_ntz"),
        F.try_to_timestamp(clock, F.lit("d MMM yyyy H:mm")).cast("timestamp_ntz"),
        F.try_to_timestamp(clock, F.lit("MMM d, yyyy")).cast("timestamp_ntz"),
    )
    raw = F.replace(F.trim(F.regexp_extract(t, f"({zone})", 1)), F.lit(":"), F.lit(""))
    offset = F.when(raw.isin("Z", "GMT", "UTC"), 0).otherwise(
        F.concat(F.substring(raw, 1, 1), F.lit("1")).try_cast("int")
        * (F.substring(raw, 2, 2).try_cast("int") * 60 + F.substring(raw, 4, 2).try_cast("int"))
    )
    wrong = F.lit(False) if offset_is_wrong is None else F.coalesce(offset_is_wrong, F.lit(False))
    local = F.to_utc_timestamp(naive.cast("timestamp"), tz)
    absolute = F.timestamp_seconds(naive.cast("timestamp").cast("double") - offset * 60)
    return F.when((raw == "") | wrong, local).otherwise(absolute)


def first_acceptable(candidates: Column, seen_at: Column, offset_is_wrong: Column | None = None) -> Column:
    """First parsable candidate, in order, not more than two hours after ``seen_at``; NULL if none."""
    limit = seen_at + F.expr(f"interval {MAX_FUTURE_HOURS} hours")
    parsed = F.transform(candidates, lambda c: free_datetime(c, offset_is_wrong))
    fine = F.filter(parsed, lambda t: t.isNotNull() & F.coalesce(t <= limit, F.lit(True)))
    return F.get(fine, F.lit(0))
