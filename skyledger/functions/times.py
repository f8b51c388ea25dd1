"""Dates, schedules, buckets and delays."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import cache
from zoneinfo import available_timezones

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.text import strip

# Formats of provider dates and durations.
DOTNET_DATE = r"^/Date\((-?\d+)([+-]\d{4})?\)/$"
HOURS = r"(?U)([0-9]+)\s*(?:h|hour|小时)"
MINUTES = r"(?U)([0-9]+)\s*(?:m|min|minute|分钟)"

# Milliseconds of 0001-01-01 and of the end of 9999-12-31.
_FIRST_MS, _LAST_MS = -62135596800000, 253402300799999


# A column function repeats its input wherever it needs it, and Spark evaluates
# every copy. The functions below therefore use each input as few times as they can.


def _found(text: Column, pattern: str, group: int) -> Column:
    """Matched group, or null without a match (a cast of empty text is slow)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _signed_minutes(offset: Column) -> Column:
    """Minutes of an offset such as ``+0800``; null for an empty text."""
    number = offset.try_cast("int")
    return F.call_function("div", number, F.lit(100)) * 60 + number % 100


def parse_fare_date(raw: Column) -> Column:
    """ISO date (first 10 characters) or ``/Date(ms+hhmm)/`` at its own offset."""
    text = strip(raw)
    millis = _found(text, DOTNET_DATE, 1).try_cast("bigint")
    minutes = F.coalesce(_signed_minutes(_found(text, DOTNET_DATE, 2)), F.lit(0))
    shifted = F.when(millis.between(_FIRST_MS, _LAST_MS), millis) + minutes * 60_000
    dotnet = F.date_from_unix_date(F.floor(shifted / 86_400_000).cast("int"))
    # Only the two full ISO forms; a cast alone would also take shorter texts.
    iso = _found(text, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    compact = F.regexp_replace(F.substring(text, 1, 10), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date")
    digits = text.rlike(r"^\d{8}$")
    return F.when(text.startswith("/"), dotnet).when(digits, compact).otherwise(iso)


def is_null_date_marker(raw: Column) -> Column:
    """A ``/Date(ms)/`` before 1970 stands for "no date"."""
    millis = _found(strip(raw), DOTNET_DATE, 1).try_cast("bigint")
    return F.coalesce(millis < 0, F.lit(False))


def parse_minutes(raw: Column) -> Column:
    """Minutes from digits or from texts such as ``3h 5m``; null if unknown or beyond a long."""
    text = F.lower(raw)
    plain = _found(text, r"(?U)^\s*([0-9]+)\s*$", 1).try_cast("bigint")
    hours = _found(text, HOURS, 1).try_cast("bigint")
    minutes = _found(text, MINUTES, 1).try_cast("bigint")
    # Either part may be missing, but not both.
    whole = F.try_multiply(hours, F.lit(60).cast("bigint"))
    parts = F.when(hours.isNotNull(), F.try_add(whole, F.coalesce(minutes, F.lit(0)))).otherwise(minutes)
    return F.coalesce(plain, parts)


def parse_schedule(raw: Column, zone: Column) -> Column:
    """Struct of raw text, local time, offset in minutes (if given) and zone."""
    text = F.replace(F.replace(strip(raw), F.lit("/"), F.lit("-")), F.lit("Z"), F.lit("+00:00"))
    offset = _found(text, r"[T ].*([+-]\d{2}:?\d{2})$", 1)
    local = _found(
        text, r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?)([+-]\d{2}:?\d{2})?$", 1
    )
    return F.struct(
        strip(raw).alias("raw"),
        local.try_cast("timestamp_ntz").alias("local"),
        _signed_minutes(F.replace(offset, F.lit(":"), F.lit(""))).alias("offset_minutes"),
        zone.alias("zone"),
    )


@cache
def zone_names() -> tuple[str, ...]:
    """Time zones of the IANA list that the session's Java can convert."""
    ids = SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds()
    return tuple(sorted(available_timezones() & set(ids)))


def known_zone(zone: Column) -> Column:
    """True when the text names a time zone that every conversion knows."""
    return zone.isin(*zone_names())


def offset_label(minutes: Column) -> Column:
    """``UTC+08:00`` for an offset in minutes."""
    size = F.abs(minutes)
    return F.concat(
        F.lit("UTC"),
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def local_to_utc(schedule: Column) -> Column:
    """Struct (utc, zone label) of a parsed schedule; utc is null without a zone."""
    local, offset, zone = (schedule[name] for name in ("local", "offset_minutes", "zone"))
    by_offset = F.timestamp_add("MINUTE", -offset, local)
    usable = F.when(known_zone(zone), zone)
    by_zone = F.to_utc_timestamp(local.cast("timestamp"), usable).cast("timestamp_ntz")
    return F.struct(
        F.when(offset.isNotNull(), by_offset).otherwise(by_zone).alias("utc"),
        F.when(offset.isNotNull(), F.coalesce(zone, offset_label(offset))).otherwise(zone).alias("zone"),
    )


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 of a UTC wall-clock timestamp."""
    return F.unix_seconds(moment.cast("timestamp"))


def add_seconds(moment: Column, seconds: Column) -> Column:
    """Timestamp plus a whole number of seconds, as a plain UTC timestamp."""
    return F.timestamp_add("SECOND", seconds, moment.cast("timestamp_ntz"))


def bucket_index(moment: Column, seconds: int) -> Column:
    """Number of the fixed-size time bucket that holds the moment."""
    return F.floor(epoch_seconds(moment) / F.lit(seconds)).cast("bigint")


def bucket_start(moment: Column, resolution: str) -> Column:
    """UTC hour or day that holds the moment."""
    return F.date_trunc(resolution, moment).cast("timestamp_ntz")


def advance_due_at(previous: Column, interval_seconds: Column, now: Column) -> Column:
    """Next due time on the old grid; missed periods are skipped."""
    elapsed = epoch_seconds(now) - epoch_seconds(previous)
    periods = F.floor(elapsed / interval_seconds) + 1
    on_grid = add_seconds(previous, (periods * interval_seconds).cast("bigint"))
    fresh = add_seconds(now, interval_seconds.cast("bigint"))
    return F.when(previous.isNull() | (previous > now), fresh).otherwise(on_grid)


def retry_delay(attempt: Column, base: float, maximum: float, multiplier: float = 2.0, jitter: Column | None = None) -> Column:
    """Exponential delay in seconds with a bounded share of jitter (0 to 1)."""
    plain = F.least(
        F.lit(float(maximum)), F.lit(float(base)) * F.pow(F.lit(float(multiplier)), attempt - 1)
    )
    if jitter is None:
        return plain
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), jitter))
    return F.least(F.lit(float(maximum)), plain + plain * bounded)


def full_utc_days(since: datetime, as_of: datetime) -> tuple[datetime, datetime]:
    """Start and end midnight of the whole UTC days inside ``[since, as_of]``."""
    start = since.replace(hour=0, minute=0, second=0, microsecond=0)
    if start != since:
        start += timedelta(days=1)
    end = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return start, max(start, end)


def history_resolution(requested: str, days: int) -> str:
    """``auto`` means hours up to 14 days and days beyond."""
    if requested not in ("auto", "raw", "hour", "day"):
        raise ValueError(f"unknown resolution: {requested}")
    if requested == "auto":
        return "hour" if days <= 14 else "day"
    return requested


def window_start(as_of: datetime, days: int, low: int = 2, high: int = 90) -> datetime:
    """Where a window of some days begins; a length outside its bounds is refused."""
    if not low <= days <= high:
        raise ValueError(f"days must be between {low} and {high}")
    return as_of - timedelta(days=days)
