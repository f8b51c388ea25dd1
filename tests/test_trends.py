"""Maintained trends must equal raw trends; checks against plain Python."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.operators import alerts, filters, trends
from skyledger.operators.history import run_floor, simple_minima
from skyledger.sources.fixture import generate_observations, generate_subscriptions

ANCHOR = datetime(2026, 3, 31, 9, 30)


@pytest.fixture(scope="module")
def tables(spark):
    obs = generate_observations(spark, 6, 300, 25, ANCHOR)
    subs = generate_subscriptions(spark, 3, 4, 6).withColumn("created_at", F.lit(ANCHOR).cast("timestamp_ntz"))
    queries = spark.range(6).selectExpr(
        "id AS query_id", "'alpha' AS provider", "'h' AS query_hash", "'one_way' AS trip_type",
        "CASE WHEN id % 5 = 4 THEN 'JPY' ELSE 'CNY' END AS currency", "id % 2 = 0 AS direct_only")
    empty = "cast(array() AS array<string>)"
    wishes = subs.selectExpr(
        "subscription_id", f"{empty} AS airline_codes", f"{empty} AS departure_airports", f"{empty} AS arrival_airports",
        "CASE WHEN subscription_id % 4 = 3 THEN 103000L END AS max_price_minor", "cast(NULL AS bigint) AS max_stops",
        "cast(NULL AS bigint) AS max_duration_minutes", "cast(NULL AS bigint) AS departure_minute_start",
        "cast(NULL AS bigint) AS departure_minute_end")
    features = obs.select("itinerary_id").distinct().selectExpr(
        "itinerary_id", "0L AS stop_count", "60L AS total_duration_minutes", "true AS direct_trip",
        "array('MU') AS airlines", "'PVG' AS first_origin", "0L AS first_minute", "'NRT' AS last_destination")
    return obs, filters.branches(filters.contexts(subs, queries, wishes)), features


WINDOWS = {
    "edges": (ANCHOR - timedelta(days=20), ANCHOR, None),
    "midnight": (datetime(2026, 3, 10), datetime(2026, 3, 30), None),
    "one day": (datetime(2026, 3, 20, 3), datetime(2026, 3, 20, 22), None),
    "hole": (ANCHOR - timedelta(days=20), ANCHOR, date(2026, 3, 18)),
}


@pytest.mark.parametrize("name", WINDOWS)
def test_maintained_equals_raw(spark, tables, plain, name):
    obs, branches, features = tables
    since, as_of, hole = WINDOWS[name]
    days = trends.tracked_days(obs.select("query_id"), date(2026, 3, 1), date(2026, 4, 1))
    if hole is not None:
        days = days.where((F.col("observation_date") != F.lit(hole)) | (F.col("query_id") > 2))
    coverage = trends.trend_coverage(days, obs)
    raw = trends.raw_contributions(obs, features, branches, since, as_of)
    kept = trends.trend_contributions(
        obs, features, branches, trends.daily_trend(obs), coverage, since, as_of)
    want = plain(trends.merge_points(raw, "branch_key"))
    assert want and plain(trends.merge_points(kept, "branch_key")) == want


def test_marked_rows_give_the_same_samples(spark, tables, plain):
    from skyledger.operators.writes import mark_lowest

    obs, branches, _ = tables
    plain_rows = simple_minima(run_floor(obs), branches)
    marked = simple_minima(run_floor(mark_lowest(obs)), branches)
    assert plain(plain_rows) == plain(marked)


def test_rebuilt_trend_differs_nowhere(spark, tables):
    obs, _, _ = tables
    daily = trends.daily_trend(obs)
    row = trends.verify_daily_trend(daily, daily).collect()[0]
    assert row.differences == 0 and row.expected_rows == row.stored_rows > 0


def test_previous_minimum_against_all_pairs(spark):
    rng = random.Random(3)
    data = []
    for run in range(400):
        at = datetime(2026, 1, 1) + timedelta(minutes=rng.randrange(0, 40 * 24 * 6) * 10)
        data.append((f"b{rng.choice([0, 0, 0, 1])}", run, at, rng.randrange(100, 999), True))
    best = spark.createDataFrame(
        data, "branch_key string, run_id long, observed_at timestamp_ntz, price_minor long, is_direct boolean")
    looks = [("b0", None), ("b0", 1), ("b0", 2), ("b0", 7), ("b1", 30)]
    windows = spark.createDataFrame(looks, "branch_key string, window_days long")
    got = {(r.branch_key, r.window_days, r.run_id): r.previous_minimum
           for r in alerts.previous_minimum(best, windows).collect()}
    want = {}
    for branch, days in looks:
        for key, run, at, _, _ in data:
            if key == branch:
                earlier = [p for k, _, t, p, _ in data
                           if k == branch and t < at and (days is None or t >= at - timedelta(days=days))]
                want[branch, days, run] = min(earlier, default=None)
    assert got == want


def test_cooldown_and_fallback_channels(spark, plain):
    now = datetime(2026, 1, 2)
    events = spark.createDataFrame(
        [(1, 10, "new_low", now, 3600), (1, 11, "new_low", now + timedelta(1), 3600), (2, 10, "new_low", now, 3600),
         (3, 10, "new_low", now, 0), (3, 11, "new_low", now, 0)],
        "rule_id long, run_id long, rule_type string, observed_at timestamp_ntz, cooldown_seconds long")
    stored = spark.createDataFrame([(2, now - timedelta(seconds=3600)), (1, now - timedelta(seconds=3601))],
                                   "rule_id long, created_at timestamp_ntz")
    assert plain(alerts.apply_cooldown(events, stored, now), "rule_id", "run_id") == [(1, 10), (3, 10), (3, 11)]
    rules = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "rule_id long, user_id long")
    links = spark.createDataFrame([(1, 50), (2, 51), (3, 50)], "rule_id long, channel_id long")
    channels = spark.createDataFrame([(50, 5, True), (51, 5, False), (52, 5, True), (60, 6, True)],
                                     "channel_id long, user_id long, enabled boolean")
    assert plain(alerts.rule_targets(rules, links, channels)) == [(1, 50), (2, 50), (2, 52), (3, 60)]


def test_previous_minimum_travels_with_numbers(spark):
    """Names of branches are long hashes: after the first join rows go on with a number."""
    at = datetime(2026, 1, 1)
    best = spark.createDataFrame(
        [("b0", 1, at, 5, True), ("b0", 2, at + timedelta(days=3), 4, True)],
        "branch_key string, run_id long, observed_at timestamp_ntz, price_minor long, is_direct boolean")
    windows = spark.createDataFrame([("b0", None), ("b0", 7)], "branch_key string, window_days long")
    rows = alerts.previous_minimum(best, windows)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pair" in plan and "hashpartitioning(branch_key" not in plan
    assert sorted((r.window_days or 0, r.run_id, r.previous_minimum) for r in rows.collect()) == [
        (0, 1, None), (0, 2, 5), (7, 1, None), (7, 2, 5)]


def test_written_copy_is_compressed(spark):
    from skyledger.session import cut_lineage

    copy = cut_lineage(spark.range(100).selectExpr("id", "repeat('x', 1000) AS text"))
    assert copy.inputFiles() and all(f.endswith(".snappy.parquet") for f in copy.inputFiles())
    assert copy.where("length(text) = 1000").count() == 100
