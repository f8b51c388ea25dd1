"""Deliveries: which are due, when to try again, and when a channel may speak."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.times import add_seconds, retry_delay

# Fixed values of the delivery schedule.
STUCK_SECONDS = 900
LONGEST_RETRY_SECONDS = 86_400
SEARCH_DAYS = 15


def deliverable(deliveries: DataFrame, channels: DataFrame, now: datetime) -> DataFrame:
    """Pending and failed deliveries whose time has come, and stuck ones."""
    at = F.lit(now).cast("timestamp_ntz")
    stuck_before = F.lit(now - timedelta(seconds=STUCK_SECONDS)).cast("timestamp_ntz")
    status, next_at = F.col("status"), F.col("next_attempt_at")
    due = (
        ((status == "pending") & (next_at.isNull() | (next_at <= at)))
        | ((status == "failed") & (next_at <= at))
        | ((status == "sending") & (F.col("updated_at") <= stuck_before))
    )
    usable = channels.where("enabled").select("channel_id")
    return deliveries.where(due).join(usable, "channel_id", "left_semi")


def retry_at(now: Column, attempt: Column, base_seconds: int, most_attempts: int) -> Column:
    """Time of the next try after a failed one; null when no try is left."""
    earlier = F.greatest(attempt, F.lit(1))
    delay = retry_delay(earlier, base_seconds, LONGEST_RETRY_SECONDS).cast("bigint")
    return F.when(attempt < most_attempts, add_seconds(now, delay))


def _local(moment: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(moment.cast("timestamp"), zone).cast("timestamp_ntz")


def _instant(local: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz")


def _plus(moment: Column, unit: str, amount) -> Column:
    return F.timestamp_add(unit, amount if isinstance(amount, Column) else F.lit(amount), moment)


def allowed_at(local: Column, quiet_start: Column, quiet_end: Column, weekdays: Column) -> Column:
    """Local time outside the quiet hours and on an allowed weekday (0 is Monday)."""
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    start, end = quiet_start * 60, quiet_end * 60
    inside = F.when(start < end, (second >= start) & (second < end)).otherwise((second >= start) | (second < end))
    awake = quiet_start.isNull() | quiet_end.isNull() | ~inside
    return (weekdays.isNull() | F.array_contains(weekdays, F.weekday(local))) & awake


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to an expression that needs it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def wall_clock_instants(local: Column, zone: Column) -> Column:
    """UTC instants of a wall-clock time: one, two in a repeated hour.

    A time that a clock change leaves out moves to the first minute that exists.
    """

    def existing(there: Column) -> Column:
        steps = F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.timestamp_diff("MINUTE", local, there)),
            lambda m: _plus(local, "MINUTE", m),
        )
        moved = F.array_min(F.filter(steps, lambda x: _local(_instant(x, zone), zone) == x))
        return F.when(there == local, local).otherwise(moved)

    def with_later(real: Column, first: Column) -> Column:
        next_day = _plus(first, "DAY", 1)
        offset = F.timestamp_diff("SECOND", next_day, _local(next_day, zone))
        later = _bind(_plus(real, "SECOND", -offset), lambda x: F.when(
            (x != first) & (_local(x, zone) == real), x))
        return F.array_compact(F.array(first, later))

    return _bind(
        _bind(_local(_instant(local, zone), zone), existing),
        lambda real: _bind(_instant(real, zone), lambda first: with_later(real, first)),
    )


def next_delivery_at(
    moment: Column, zone: Column, quiet_start: Column, quiet_end: Column, weekdays: Column
) -> Column:
    """The first allowed time at or after the moment, within 15 local days.

    Only local midnights and quiet-hour ends can open a channel, so those times
    are tried. All is one expression per row.
    """
    free = quiet_start.isNull() & weekdays.isNull()
    here = _local(moment, zone)
    midnight = F.date_trunc("day", here).cast("timestamp_ntz")
    minutes = F.array_compact(F.array(F.lit(0), quiet_end.cast("int")))

    def openings(day: Column) -> Column:
        return F.flatten(F.transform(minutes, lambda m: wall_clock_instants(
            _plus(_plus(midnight, "DAY", day), "MINUTE", m), zone)))

    def first_opening(start: int, stop: int) -> Column:
        candidates = F.flatten(F.transform(F.sequence(F.lit(start), F.lit(stop)), openings))
        return F.array_min(F.filter(
            candidates,
            lambda c: (c >= moment) & allowed_at(_local(c, zone), quiet_start, quiet_end, weekdays),
        ))

    # Later days can only give later times, so they are looked at only when needed.
    found = F.coalesce(first_opening(0, 1), first_opening(2, 4), first_opening(5, SEARCH_DAYS - 1))
    return F.when(free | allowed_at(here, quiet_start, quiet_end, weekdays), moment).otherwise(found)
