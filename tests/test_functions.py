"""Tables of inputs and expected values for the column functions."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from skyledger.operators import filters as fl
from skyledger.functions import money, text, times
from skyledger.operators import delivery


def values(spark, data, schema, column):
    return [r[0] for r in spark.createDataFrame(data, schema).coalesce(1).select(column).collect()]


def test_money_texts(spark):
    data = [("2310", "CNY"), ("CNY 2,180", "CNY"), ("2265.5", "CNY"), ("0.005", "CNY"), ("2180", "JPY"),
            ("2180.5", "KRW"), ("-3", "CNY"), ("n/a", "CNY"), (None, "CNY"), ("1.2.3", "CNY"), ("12-3", "CNY")]
    got = values(spark, data, "raw string, cur string", money.to_minor_units(F.col("raw"), F.col("cur")))
    assert got == [231000, 218000, 226550, 1, 2180, 2181, None, None, None, None, None]


def test_drop_is_cut_toward_zero(spark):
    data = [(990, 1000), (999, 1000), (1001, 1000), (5, 0), (5, None), (2, 3)]
    got = values(spark, data, "now long, before long", money.drop_basis_points(F.col("now"), F.col("before")))
    assert got == [100, 10, -10, 0, 0, 3333]


def test_dates(spark):
    data = [("2026-08-15",), (" 2026-08-15T10:00:00",), ("/Date(1786723200000+0800)/",), ("/Date(1786723200000)/",),
            ("20260815",), ("2026-8-15",), ("2026-02-30",), ("soon",), (None,), ("/Date(253402300800000)/",)]
    got = values(spark, data, "raw string", times.parse_fare_date(F.col("raw")))
    assert got == [date(2026, 8, 15), date(2026, 8, 15), date(2026, 8, 15), date(2026, 8, 14), date(2026, 8, 15),
                   None, None, None, None, None]
    marks = values(spark, [("/Date(-62135596800000)/",), ("/Date(0)/",), ("x",)], "raw string",
                   times.is_null_date_marker(F.col("raw")))
    assert marks == [True, False, False]


def test_minutes(spark):
    data = [("95",), ("3h 5m",), ("2 小时",), ("45分钟",), ("1 hour",), ("3.5",), ("long",), ("",), (None,)]
    assert values(spark, data, "raw string", times.parse_minutes(F.col("raw"))) == [
        95, 185, 120, 45, 60, None, None, None, None]


def test_schedule_to_utc(spark):
    data = [("2026/08/15 08:00", "Asia/Shanghai"), ("2026-08-15T08:00:00Z", None), ("2026-08-15T08:00:00-0330", None),
            ("2026-08-15T08:00:00", "Mars/Base"), ("2026-08-15T08:00:00", None), ("tomorrow", "UTC"),
            ("2026-03-08T02:30:00", "America/New_York"), ("2026-11-01T01:30:00", "America/New_York")]
    column = times.local_to_utc(times.parse_schedule(F.col("raw"), F.col("zone")))
    got = [tuple(v) for v in values(spark, data, "raw string, zone string", column)]
    assert got == [
        (datetime(2026, 8, 15, 0, 0), "Asia/Shanghai"), (datetime(2026, 8, 15, 8, 0), "UTC+00:00"),
        (datetime(2026, 8, 15, 11, 30), "UTC-03:30"), (None, "Mars/Base"), (None, None), (None, "UTC"),
        (datetime(2026, 3, 8, 7, 30), "America/New_York"), (datetime(2026, 11, 1, 5, 30), "America/New_York")]


def test_csv_cells(spark):
    data = [("=1+1",), (" +SUM",), ("-2",), ("@cmd",), ("\tx",), ("\rx",), ("plain",), ("a=b",)]
    got = values(spark, data, "raw string", text.csv_safe(F.col("raw")))
    assert [g.startswith("'") for g in got] == [True] * 6 + [False] * 2


def test_urls_lose_secrets(spark):
    data = [("https://me:pw@Host.example:8443/a/B?x=1#y",), ("http://h/p#z?q",), ("https://h",)]
    assert values(spark, data, "raw string", text.strip_url(F.col("raw"))) == [
        "https://host.example:8443/a/B", "http://h/p", "https://h"]


def test_due_times_skip_missed_periods(spark):
    now = datetime(2026, 1, 1, 12, 0)
    data = [(now - timedelta(seconds=s), 3600) for s in (0, 1, 3600, 9000)] + [(None, 60), (now + timedelta(hours=1), 60)]
    column = times.advance_due_at(F.col("at"), F.col("every"), F.lit(now).cast("timestamp_ntz"))
    got = values(spark, data, "at timestamp_ntz, every long", column)
    assert got == [now + timedelta(seconds=s) for s in (3600, 3599, 3600, 1800, 60, 60)]


@pytest.mark.parametrize("since,as_of,want", [
    (datetime(2026, 1, 1), datetime(2026, 1, 3), (datetime(2026, 1, 1), datetime(2026, 1, 3))),
    (datetime(2026, 1, 1, 5), datetime(2026, 1, 3, 5), (datetime(2026, 1, 2), datetime(2026, 1, 3))),
    (datetime(2026, 1, 1, 5), datetime(2026, 1, 1, 9), (datetime(2026, 1, 2), datetime(2026, 1, 2))),
])
def test_full_days(since, as_of, want):
    assert times.full_utc_days(since, as_of) == want


def _search(moment, zone, start, end, days):
    """Minute-by-minute search in plain Python."""
    at = moment
    while True:
        local = at.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone))
        minute = local.hour * 60 + local.minute
        quiet = start is not None and (
            start <= minute < end if start < end else minute >= start or minute < end)
        if not quiet and (days is None or local.weekday() in days):
            return at
        at += timedelta(minutes=1)


def test_next_delivery_matches_a_minute_search(spark):
    cases = [
        (datetime(2026, 1, 5, 15, 0), "Asia/Shanghai", 1320, 480, None),
        (datetime(2026, 1, 5, 3, 0), "Asia/Shanghai", 1320, 480, None),
        (datetime(2026, 1, 9, 20, 0), "UTC", 1320, 480, [0, 1]),
        (datetime(2026, 3, 8, 6, 50), "America/New_York", 60, 150, None),
        (datetime(2026, 11, 1, 4, 30), "America/New_York", 0, 90, None),
        (datetime(2026, 11, 1, 5, 45), "America/New_York", 60, 90, None),
        (datetime(2026, 6, 1, 0, 0), "Asia/Kolkata", 1, 0, None),
        (datetime(2026, 1, 5, 15, 0), "UTC", None, None, None),
        (datetime(2026, 1, 5, 15, 0), "UTC", None, None, [6]),
    ]
    schema = "at timestamp_ntz, zone string, s long, e long, days array<int>"
    column = delivery.next_delivery_at(*[F.col(c) for c in ("at", "zone", "s", "e", "days")])
    got = values(spark, cases, schema, column)
    assert got == [_search(*case) for case in cases]


def test_branch_keys_are_sixteen_bytes(spark):
    """Keys of branches travel with every price, so they are short; equal wishes have equal keys."""
    subscriptions = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "subscription_id long, query_id long")
    queries = spark.createDataFrame([(5, "CNY", False), (6, "CNY", False)], "query_id long, currency string, direct_only boolean")
    wishes = ("airline_codes array<string>, departure_airports array<string>, arrival_airports array<string>, max_price_minor long, "
              "max_stops long, max_duration_minutes long, departure_minute_start long, departure_minute_end long")
    rows = [(k, ["MU"], None, None, 5, None, None, None, None) for k in (1, 2, 3)]
    keys = [bytes(r[0]) for r in fl.contexts(
        subscriptions, queries, spark.createDataFrame(rows, f"subscription_id long, {wishes}")
    ).orderBy("subscription_id").select("branch_key").collect()]
    assert [len(k) for k in keys] == [16] * 3 and keys[0] == keys[1] != keys[2]


def test_strip_removes_all_white_space_without_a_pattern(spark):
    """Every character of the first plane is kept or removed at both ends as by the pattern of white space."""
    points = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343")
    sign = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    rows = points.select(F.concat(sign, F.lit(" a "), sign, F.lit("b"), sign, F.lit(chr(0x3000)), sign).alias("t"))
    want = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert rows.where(~text.strip(F.col("t")).eqNullSafe(want)).collect() == []
    assert "regexp" not in rows.select(text.strip(F.col("t")))._jdf.queryExecution().toString()
