"""Daily rows, coverage and trends for all queries and subscriptions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from catalog.duck import AS_OF, sql
from catalog.history import contexts, few_subscriptions, samples
from catalog.registry import query
from skyledger.functions.times import window_start
from skyledger.operators import filters as fl
from skyledger.operators import trends as tr
from skyledger.session import work_dir
from skyledger.streaming import jobs
from skyledger.operators.history import time_range
from skyledger.sources.testdata import AS_OF as NOW

DAYS = 90
SINCE = window_start(NOW, DAYS)
FIRST, LAST = date(1998, 4, 1), date(1998, 6, 30)
_IN_RANGE = f"observed_at BETWEEN {AS_OF} - INTERVAL {DAYS} DAY AND {AS_OF}"
_DAILY_COLUMNS = """query_id, observation_date, currency, direct_only, lowest_price_minor, highest_price_minor,
  price_sum_minor, sample_count, first_observed_at, last_observed_at"""


@query("daily_trend", sql(f"SELECT {_DAILY_COLUMNS} FROM daily"))
def daily_trend(t):
    return tr.daily_trend(t.observations())


# Days of an even query are covered in full, an odd query misses its first days.
def coverage(t):
    days = tr.tracked_days(t.subscriptions(), FIRST, LAST)
    held = days.where((F.col("query_id") % 2 == 0) | (F.col("observation_date") >= F.lit(date(1998, 4, 10))))
    return tr.trend_coverage(held, t.observations(SINCE.replace(hour=0), NOW))


_COVERAGE = """
SELECT d.query_id, d.observation_date, s.source_last_observed_at
FROM (SELECT query_id, unnest(generate_series(DATE '1998-04-01', DATE '1998-06-30', INTERVAL 1 DAY))::DATE
      AS observation_date FROM query) d
LEFT JOIN (SELECT query_id, observed_at::DATE AS observation_date, max(observed_at) AS source_last_observed_at
           FROM obs WHERE observed_at >= TIMESTAMP '1998-04-01' AND observed_at < TIMESTAMP '1998-07-01'
           AND is_lowest GROUP BY ALL) s USING (query_id, observation_date)"""


@query("trend_coverage", sql(_COVERAGE))
def trend_coverage(t):
    days = tr.tracked_days(t.subscriptions(), FIRST, LAST)
    return tr.trend_coverage(days, t.observations(SINCE.replace(hour=0), NOW.replace(hour=23, minute=59)))


@query("coverage_split", sql("""
SELECT subscription_id, NOT needs_scan AND max_price_minor IS NULL AND query_id % 2 = 0 AS covered FROM context"""))
def coverage_split(t):
    rows = contexts(t)
    routed = tr.split_by_coverage(fl.branches(rows), coverage(t), SINCE, NOW)
    return rows.select("subscription_id", "branch_key").join(
        routed.select("branch_key", "covered"), "branch_key"
    ).drop("branch_key")


def raw_points(t):
    rows = contexts(t)
    features = fl.itinerary_features(t.itineraries(SINCE, NOW), t.segments(SINCE, NOW))
    points = tr.raw_contributions(
        t.observations(SINCE, NOW), features, fl.branches(rows), SINCE, NOW, small=few_subscriptions(t))
    return rows, points


def maintained_points(t):
    """Daily rows are built from the same months, as a stored table would hold them."""
    rows = contexts(t)
    features = fl.itinerary_features(t.itineraries(SINCE, NOW), t.segments(SINCE, NOW))
    daily = tr.daily_trend(t.observations(SINCE.replace(hour=0), NOW))
    points = tr.trend_contributions(
        t.observations(SINCE, NOW), features, fl.branches(rows), daily, coverage(t), SINCE, NOW,
        small=few_subscriptions(t))
    return rows, points


_BRANCH_SAMPLE = f"""
SELECT DISTINCT c.user_id, c.query_id, c.currency, c.airline_codes, c.departure_airports, c.arrival_airports,
  c.max_price_minor, c.max_stops, c.max_duration_minutes, c.departure_minute_start, c.departure_minute_end,
  s.run_id, s.observed_at, s.price
FROM context c JOIN sample s USING (subscription_id)
WHERE c.enabled AND c.currency = 'CNY' AND s.{_IN_RANGE}"""
_DASHBOARD = sql("""
SELECT user_id, observed_at::DATE AS bucket, min(price)::BIGINT AS lowest_price_minor,
  max(price)::BIGINT AS highest_price_minor, sum(price)::DOUBLE / count(*) AS average_price_minor,
  count(*) AS sample_count
FROM branch_sample GROUP BY ALL""", branch_sample=_BRANCH_SAMPLE)


@query("dashboard_trend_raw", _DASHBOARD)
def dashboard_trend_raw(t):
    rows, points = raw_points(t)
    return tr.dashboard_trend(points, rows, "CNY")


@query("dashboard_trend_maintained", _DASHBOARD)
def dashboard_trend_maintained(t):
    rows, points = maintained_points(t)
    return tr.dashboard_trend(points, rows, "CNY")


_ROUTE = sql(f"""
SELECT subscription_id, observed_at::DATE AS bucket, min(price)::BIGINT AS lowest_price_minor,
  max(price)::BIGINT AS highest_price_minor, sum(price)::DOUBLE / count(*) AS average_price_minor,
  count(*) AS sample_count
FROM sample WHERE {_IN_RANGE} GROUP BY ALL""")


@query("route_trend", _ROUTE)
def route_trend(t):
    rows, points = raw_points(t)
    return tr.route_trend(points, rows)


@query("route_trend_maintained", _ROUTE)
def route_trend_maintained(t):
    rows, points = maintained_points(t)
    return tr.route_trend(points, rows)


_CHANGE = f"""
SELECT {{key}} min(price) FILTER (observed_at >= {AS_OF} - INTERVAL 24 HOUR) AS current_price_minor,
  min(price) FILTER (observed_at < {AS_OF} - INTERVAL 24 HOUR) AS previous_price_minor
FROM {{source}} WHERE observed_at BETWEEN {AS_OF} - INTERVAL 48 HOUR AND {AS_OF} GROUP BY ALL"""
_PERCENT = """CASE WHEN previous_price_minor <> 0 THEN
  (current_price_minor::DOUBLE - previous_price_minor::DOUBLE) / previous_price_minor::DOUBLE * 100.0 END"""


@query("rolling_change", sql(
    f"SELECT *, {_PERCENT} AS price_change_percent FROM change",
    change=_CHANGE.format(key="subscription_id,", source="sample")))
def rolling_change(t):
    rows, minima = samples(t, NOW - timedelta(hours=48), NOW)
    per_branch = tr.rolling_change(minima, NOW, "branch_key")
    return rows.select("subscription_id", "branch_key").join(per_branch, "branch_key").drop("branch_key")


@query("dashboard_change", sql(
    f"SELECT *, {_PERCENT} AS price_change_percent FROM change",
    change=_CHANGE.format(key="c.user_id,", source="""context c JOIN sample s
      ON s.subscription_id = c.subscription_id AND c.enabled AND c.currency = 'CNY'""")))
def dashboard_change(t):
    rows, minima = samples(t, NOW - timedelta(hours=48), NOW)
    return tr.dashboard_change(minima, rows, "CNY", NOW)


@query("route_summary", sql(f"""
SELECT c.subscription_id, minimum_price_minor, maximum_price_minor, average_price_minor,
  coalesce(sample_count, 0)::BIGINT AS sample_count, CASE WHEN sample_count > 0 THEN {_PERCENT} END AS price_change_percent
FROM context c
LEFT JOIN (SELECT subscription_id, min(price) AS minimum_price_minor, max(price) AS maximum_price_minor,
    sum(price)::DOUBLE / count(*) AS average_price_minor, count(*) AS sample_count
  FROM sample WHERE {_IN_RANGE} GROUP BY 1) p USING (subscription_id)
LEFT JOIN change h USING (subscription_id)""", change=_CHANGE.format(key="subscription_id,", source="sample")))
def route_summary(t):
    rows, points = raw_points(t)
    _, minima = samples(t, NOW - timedelta(hours=48), NOW)
    return tr.route_summary(points, minima, rows, NOW)


@query("verify_daily_trend", sql("""
SELECT (SELECT count(*) FROM daily) AS expected_rows,
  (SELECT count(*) FROM daily WHERE observation_date < DATE '2001-01-01') AS stored_rows,
  (SELECT count(*) FROM daily WHERE observation_date >= DATE '2001-01-01' OR query_id % 7 = 0) AS differences,
  (SELECT count(*) FROM cover) AS expected_coverage_rows,
  (SELECT count(*) FROM cover WHERE query_id % 5 > 0) AS stored_coverage_rows,
  (SELECT count(*) FROM cover WHERE query_id % 5 = 0) AS coverage_differences""", cover=_COVERAGE))
def verify_daily_trend(t):
    """Stored tables with missing days, wrong counts and missing coverage, read back and compared with the rows."""
    base = work_dir(t.spark, "verify")
    wrong = F.when(F.col("query_id") % 7 == 0, 1).otherwise(0)
    rebuilt = tr.daily_trend(t.observations()).where(F.col("observation_date") < F.lit(date(2001, 1, 1)))
    rebuilt.withColumn("sample_count", F.col("sample_count") + wrong).write.parquet(f"{base}/daily")
    days = tr.tracked_days(t.subscriptions(), FIRST, LAST)
    covered = tr.trend_coverage(days, t.observations(SINCE.replace(hour=0), NOW.replace(hour=23, minute=59)))
    covered.where("query_id % 5 > 0").write.parquet(f"{base}/coverage")
    rows = tr.verify_daily_trend(tr.daily_trend(t.observations()), jobs.read_daily(t.spark, f"{base}/daily"))
    return rows.join(tr.verify_coverage(covered, t.spark.read.parquet(f"{base}/coverage")))


@query("service_date_prices", sql("""
SELECT query_id, currency, is_direct, departure_date AS service_date,
  min(total_price_minor) AS lowest_price_minor, count(*) AS sample_count, min(observed_at) AS first_observed_at,
  max(observed_at) AS last_observed_at
FROM obs JOIN leg USING (query_id) WHERE position = 0 GROUP BY ALL"""))
def service_date_prices(t):
    return tr.service_date_prices(t.observations(), t.legs())


@query("maintenance_page", sql("""
SELECT observation_date, query_id, row_number() OVER (ORDER BY observation_date, query_id) AS page_row, true AS has_more
FROM (SELECT query_id, unnest(generate_series(DATE '1998-04-01', DATE '1998-06-30', INTERVAL 1 DAY))::DATE
      AS observation_date FROM query)
WHERE (observation_date, query_id) > (DATE '1998-04-03', 20) ORDER BY observation_date, query_id LIMIT 500"""))
def maintenance_page(t):
    days = tr.tracked_days(t.subscriptions(), FIRST, LAST)
    return tr.maintenance_page(days, 500, (date(1998, 4, 3), 20))
