"""Filters and price history for all subscriptions."""

from __future__ import annotations


from pyspark.sql import functions as F

from catalog.duck import AS_OF, sql
from catalog.registry import query
from skyledger.functions.times import window_start
from skyledger.operators.paging import page_ends
from skyledger.operators import filters as fl
from skyledger.operators import history as hi
from skyledger.skew import fits_broadcast
from skyledger.sources.testdata import AS_OF as NOW

YEAR_AGO = window_start(NOW, 365, high=365)
SINCE = f"{AS_OF} - INTERVAL 365 DAY"


def contexts(t):
    return fl.contexts(t.subscriptions(), t.queries(), t.filters())


def few_subscriptions(t):
    """There are at most as many branches as subscriptions."""
    return fits_broadcast(t.subscriptions().select("subscription_id"))


def samples(t, since=YEAR_AGO, until=NOW):
    """Context rows and the run samples of their branches in a time range."""
    rows = contexts(t)
    obs = hi.time_range(t.observations(since, until), since, until)
    features = fl.itinerary_features(t.itineraries(since, until), t.segments(since, until))
    return rows, hi.run_minima(obs, features, fl.branches(rows), small=few_subscriptions(t))


_BUCKETS = """min(price)::BIGINT AS lowest_price_minor, max(price)::BIGINT AS highest_price_minor,
  avg(price) AS average_price_minor, count(*) AS sample_count"""
_WINDOW = f"observed_at BETWEEN {SINCE} AND {AS_OF}"


@query("run_minima_filtered", sql(f"""
SELECT subscription_id, run_id, observed_at, price AS price_minor FROM sample WHERE {_WINDOW}"""))
def run_minima_filtered(t):
    rows, minima = samples(t)
    return hi.for_subscriptions(minima, rows)


@query("history_summary", sql(f"""
SELECT subscription_id, min(price) AS minimum_price_minor, max(price) AS maximum_price_minor,
  avg(price) AS average_price_minor, count(*) AS sample_count FROM sample WHERE {_WINDOW} GROUP BY 1"""))
def history_summary(t):
    rows, minima = samples(t)
    return hi.for_subscriptions(hi.history_summary(minima, "branch_key"), rows)


@query("history_day", sql(f"""
SELECT subscription_id, date_trunc('day', observed_at)::TIMESTAMP AS bucket, {_BUCKETS} FROM sample WHERE {_WINDOW}
GROUP BY 1, 2"""))
def history_day(t):
    rows, minima = samples(t)
    return hi.for_subscriptions(hi.history_buckets(minima, "day", "branch_key"), rows)


@query("history_hour", sql(f"""
SELECT subscription_id, date_trunc('hour', observed_at)::TIMESTAMP AS bucket, {_BUCKETS} FROM sample WHERE {_WINDOW}
GROUP BY 1, 2"""))
def history_hour(t):
    rows, minima = samples(t)
    return hi.for_subscriptions(hi.history_buckets(minima, "hour", "branch_key"), rows)


@query("history_auto", sql(f"""
SELECT subscription_id, date_trunc('day', observed_at)::TIMESTAMP AS bucket, {_BUCKETS} FROM sample WHERE {_WINDOW}
GROUP BY 1, 2"""))
def history_auto(t):
    """A window of more than 14 days gives days."""
    rows, minima = samples(t)
    return hi.for_subscriptions(hi.history_at(minima, "auto", 365, "branch_key"), rows)


def _matching(t, condition):
    """Offers with the subscriptions of their query for which one condition holds."""
    features = fl.itinerary_features(t.itineraries(), t.segments())
    rows = contexts(t)
    pairs = fl.with_branches(t.offers(), features, fl.branches(rows), small=few_subscriptions(t)).where(condition)
    counted = pairs.groupBy("branch_key").agg(
        F.count(F.lit(1)).alias("offers"), F.min("total_price_minor").alias("lowest_price_minor")
    )
    return hi.for_subscriptions(counted, rows)


def _oracle(condition: str) -> str:
    return sql(f"""
SELECT c.subscription_id, count(*) AS offers, min(o.total_price_minor) AS lowest_price_minor
FROM context c JOIN offer o USING (query_id, currency) JOIN itinerary i USING (itinerary_id)
WHERE {condition} GROUP BY 1""")


_FIRST = """EXISTS (SELECT 1 FROM segment s WHERE s.itinerary_id = i.itinerary_id AND s.leg_position = 0
  AND s.position = 0 AND (len(c.departure_airports) = 0 OR list_contains(c.departure_airports, s.origin))
  AND (c.departure_minute_start IS NULL OR c.departure_minute_end IS NULL
       OR (hour(s.departure_local) * 60 + minute(s.departure_local) >= c.departure_minute_start
           AND hour(s.departure_local) * 60 + minute(s.departure_local) < c.departure_minute_end)))"""

_SIMPLE = {
    "filter_direct": (lambda: fl.direct_match(), "NOT c.direct_only OR i.is_direct"),
    "filter_max_stops": (
        lambda: fl.within("max_stops", "stop_count"), "c.max_stops IS NULL OR i.stop_count <= c.max_stops"),
    "filter_max_duration": (
        lambda: fl.within("max_duration_minutes", "total_duration_minutes"),
        "c.max_duration_minutes IS NULL OR i.total_duration_minutes <= c.max_duration_minutes"),
    "filter_max_price": (
        lambda: fl.within("max_price_minor", "total_price_minor"),
        "c.max_price_minor IS NULL OR o.total_price_minor <= c.max_price_minor"),
    "filter_airline": (
        lambda: fl.airline_match(),
        """len(c.airline_codes) = 0 OR EXISTS (SELECT 1 FROM segment s WHERE s.itinerary_id = i.itinerary_id
           AND list_contains(c.airline_codes, s.marketing_airline))"""),
    "filter_departure": (
        lambda: fl.departure_match(),
        f"(len(c.departure_airports) = 0 AND c.departure_minute_start IS NULL) OR {_FIRST}"),
    "filter_arrival": (
        lambda: fl.arrival_match(),
        """len(c.arrival_airports) = 0 OR (SELECT arg_max(s.destination, s.position) FROM segment s
           WHERE s.itinerary_id = i.itinerary_id AND s.leg_position = 0) IN (SELECT unnest(c.arrival_airports))"""),
}

for _name, (_condition, _sql) in _SIMPLE.items():
    query(_name, _oracle(_sql))(lambda t, make=_condition: _matching(t, make()))


@query("filter_all", sql("""
SELECT subscription_id, count(*) AS offers, min(total_price_minor) AS lowest_price_minor FROM passing GROUP BY 1"""))
def filter_all(t):
    rows = contexts(t)
    features = fl.itinerary_features(t.itineraries(), t.segments())
    passing = fl.apply_fare_filters(t.offers(), features, fl.branches(rows), small=few_subscriptions(t))
    counted = passing.groupBy("branch_key").agg(
        F.count(F.lit(1)).alias("offers"), F.min("total_price_minor").alias("lowest_price_minor")
    )
    return hi.for_subscriptions(counted, rows)


@query("filter_routing", sql("""
SELECT subscription_id, needs_scan, NOT needs_scan AND max_price_minor IS NULL AS daily_ok FROM context"""))
def filter_routing(t):
    return contexts(t).select(
        "subscription_id", fl.requires_itinerary_scan().alias("needs_scan"),
        fl.supports_daily_aggregate().alias("daily_ok"),
    )


@query("history_raw_page", sql(f"""
SELECT subscription_id, run_id, observed_at, price AS price_minor, page_row, total > 5 AS has_more FROM (
  SELECT *, count(*) OVER (PARTITION BY subscription_id) AS total,
    row_number() OVER (PARTITION BY subscription_id ORDER BY observed_at, run_id) AS page_row
  FROM sample WHERE {_WINDOW}) WHERE page_row <= 5"""))
def history_raw_page(t):
    rows, minima = samples(t)
    return hi.for_subscriptions(hi.history_pages(minima, 5), rows)


@query("history_raw_second_page", sql(f"""
SELECT subscription_id, run_id, observed_at, price AS price_minor, page_row - 5 AS page_row, total > 10 AS has_more FROM (
  SELECT *, count(*) OVER (PARTITION BY subscription_id) AS total,
    row_number() OVER (PARTITION BY subscription_id ORDER BY observed_at, run_id) AS page_row
  FROM sample WHERE {_WINDOW}) WHERE page_row BETWEEN 6 AND 10"""))
def history_raw_second_page(t):
    rows, minima = samples(t)
    ends = page_ends(hi.history_pages(minima, 5), ["branch_key"], hi.HISTORY_ORDER)
    return hi.for_subscriptions(hi.history_pages(minima, 5, ends), rows)


@query("history_day_page", sql(f"""
SELECT subscription_id, bucket, lowest_price_minor, page_row, total > 5 AS has_more FROM (
  SELECT *, count(*) OVER (PARTITION BY subscription_id) AS total,
    row_number() OVER (PARTITION BY subscription_id ORDER BY bucket) AS page_row
  FROM (SELECT subscription_id, date_trunc('day', observed_at)::TIMESTAMP AS bucket,
          min(price)::BIGINT AS lowest_price_minor FROM sample WHERE {_WINDOW} GROUP BY 1, 2)) WHERE page_row <= 5"""))
def history_day_page(t):
    rows, minima = samples(t)
    pages = hi.bucket_pages(hi.history_buckets(minima, "day", "branch_key"), 5)
    return hi.for_subscriptions(pages, rows).select(
        "subscription_id", "bucket", "lowest_price_minor", "page_row", "has_more")


@query("owner_counts", sql("""
SELECT subscription_id, name, needs_scan FROM context WHERE user_id = 7"""))
def owner_counts(t):
    return fl.owner_scope(contexts(t), 7).select(
        "subscription_id", "name", fl.requires_itinerary_scan().alias("needs_scan"))
