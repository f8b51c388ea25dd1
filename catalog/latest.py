"""Newest fares, snapshots, calendars and itinerary views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.duck import AS_OF, sql
from catalog.history import contexts, few_subscriptions
from catalog.registry import query
from skyledger.functions.times import window_start
from skyledger.operators.paging import page_ends
from skyledger.operators import calendars as ca
from skyledger.operators import filters as fl
from skyledger.operators import itineraries as it
from skyledger.operators import latest as la
from skyledger.operators import writes as wr
from skyledger.operators.history import for_subscriptions
from skyledger.sources.testdata import AS_OF as NOW


def passing_latest(t):
    rows = contexts(t)

    def features_of(kept):
        return fl.itinerary_features(
            la.only_itineraries(t.itineraries(), kept), la.only_itineraries(t.segments(), kept))

    offers = t.offers().drop("cabin", "base_price_minor", "tax_minor", "seats_remaining")
    return rows, la.passing_latest(
        offers, t.runs(), features_of, fl.branches(rows), small=few_subscriptions(t))


_LATEST_RUN = """SELECT query_id, run_id, finished_at FROM run WHERE status = 'succeeded'
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY finished_at DESC, run_id DESC) = 1"""
_PASSING = "SELECT p.*, l.finished_at FROM passing p JOIN latest_run l USING (query_id, run_id)"


@query("latest_run", sql("SELECT * FROM latest_run", latest_run=_LATEST_RUN))
def latest_run(t):
    return la.latest_runs(t.runs())


@query("latest_fares", sql("""
SELECT subscription_id, run_id, finished_at AS observed_at, total_price_minor, currency FROM latest_pass
QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY total_price_minor, offer_id) = 1""",
    latest_run=_LATEST_RUN, latest_pass=_PASSING))
def latest_fares(t):
    rows, passing = passing_latest(t)
    return la.latest_fares(passing, rows)


@query("offer_total", sql("SELECT subscription_id, count(*) AS total FROM latest_pass GROUP BY 1",
                          latest_run=_LATEST_RUN, latest_pass=_PASSING))
def offer_total(t):
    rows, passing = passing_latest(t)
    return for_subscriptions(la.offer_totals(passing), rows)


@query("offer_page", sql("""
SELECT subscription_id, offer_id, total_price_minor, page_row, total > 3 AS has_more FROM (
  SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY total_price_minor, offer_id) AS page_row,
    count(*) OVER (PARTITION BY subscription_id) AS total FROM latest_pass) WHERE page_row <= 3""",
    latest_run=_LATEST_RUN, latest_pass=_PASSING))
def offer_page(t):
    rows, passing = passing_latest(t)
    pages = la.offer_pages(passing, 3).select(
        "branch_key", "offer_id", "total_price_minor", "page_row", "has_more")
    return for_subscriptions(pages, rows)


@query("offer_second_page", sql("""
SELECT subscription_id, offer_id, total_price_minor, page_row - 3 AS page_row, total > 6 AS has_more FROM (
  SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY total_price_minor, offer_id) AS page_row,
    count(*) OVER (PARTITION BY subscription_id) AS total FROM latest_pass) WHERE page_row BETWEEN 4 AND 6""",
    latest_run=_LATEST_RUN, latest_pass=_PASSING))
def offer_second_page(t):
    rows, passing = passing_latest(t)
    ends = page_ends(la.offer_pages(passing, 3), ["branch_key"], la.OFFER_ORDER)
    pages = la.offer_pages(passing, 3, ends).select("branch_key", "offer_id", "total_price_minor", "page_row", "has_more")
    return for_subscriptions(pages, rows)


@query("lowest_route_price", sql("""
SELECT user_id, CASE WHEN count(DISTINCT f.currency) = 1 THEN min(total_price_minor) END AS lowest_price_minor,
  count(*) AS priced_routes
FROM (SELECT * FROM latest_pass
  QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY total_price_minor, offer_id) = 1) f
JOIN sub USING (subscription_id) GROUP BY 1""", latest_run=_LATEST_RUN, latest_pass=_PASSING))
def lowest_route_price(t):
    rows, passing = passing_latest(t)
    latest = la.latest_fares(passing, rows)
    return la.lowest_route_price(latest.join(rows.select("subscription_id", "user_id"), "subscription_id"))


@query("price_status", sql(f"""
SELECT subscription_id, CASE WHEN finished_at IS NULL THEN 'unavailable'
  WHEN {AS_OF} - finished_at > greatest(INTERVAL 1 HOUR, to_seconds(2 * poll_interval_seconds)) THEN 'stale'
  ELSE 'current' END AS price_status
FROM sub LEFT JOIN (SELECT query_id, max(finished_at) AS finished_at FROM run
  WHERE status = 'succeeded' AND finished_at <= {AS_OF} GROUP BY 1) USING (query_id)"""))
def price_status(t):
    known = t.runs().where(F.col("finished_at") <= F.lit(NOW).cast("timestamp_ntz"))
    joined = t.subscriptions().join(la.latest_runs(known), "query_id", "left")
    return joined.select("subscription_id", fl.price_status(
        F.col("finished_at"), F.col("poll_interval_seconds"), NOW).alias("price_status"))


_PRICE_SNAPSHOT = """
SELECT query_id, currency, is_direct, observed_at, run_id, total_price_minor, offer_fingerprint, itinerary_id, offer_id
FROM obs QUALIFY row_number() OVER (PARTITION BY query_id, currency, is_direct
  ORDER BY observed_at DESC, run_id DESC, total_price_minor, offer_fingerprint) = 1"""


@query("price_snapshot", sql(_PRICE_SNAPSHOT))
def price_snapshot(t):
    return wr.upsert_price_snapshot(None, t.observations())


@query("price_snapshot_late_batch", sql(_PRICE_SNAPSHOT))
def price_snapshot_late_batch(t):
    """Newer months first, older months later: the result must be the same."""
    cut = F.lit(NOW).cast("timestamp_ntz")
    newer = wr.upsert_price_snapshot(None, t.observations().where(F.col("observed_at") >= cut))
    return wr.upsert_price_snapshot(newer, t.observations().where(F.col("observed_at") < cut))


_CALENDAR_SNAPSHOT = """
SELECT query_id, departure_date, return_date, currency, observed_at, run_id, lowest_price_minor, total_price_minor,
  false AS direct_verified
FROM calobs QUALIFY row_number() OVER (PARTITION BY query_id, departure_date, return_date, currency
  ORDER BY observed_at DESC, run_id DESC, lowest_price_minor, fingerprint) = 1"""


@query("calendar_snapshot", sql(_CALENDAR_SNAPSHOT))
def calendar_snapshot(t):
    return wr.upsert_calendar_snapshot(None, t.calendar_observations())


def routes(t):
    return ca.route_dates(contexts(t), t.legs())


_ROUTE = """SELECT subscription_id, c.query_id, currency, trip_type = 'round_trip' AS round_trip,
  a.departure_date, b.departure_date AS return_date
FROM context c JOIN leg a ON a.query_id = c.query_id AND a.position = 0
LEFT JOIN leg b ON b.query_id = c.query_id AND b.position = 1"""


@query("latest_calendar_fares", sql("""
SELECT subscription_id, r.currency, round_trip, s.observed_at, s.run_id, s.lowest_price_minor, s.total_price_minor,
  s.direct_verified
FROM route_dates r JOIN calendar_snapshot s ON s.query_id = r.query_id AND s.currency = r.currency
  AND s.departure_date = r.departure_date AND s.return_date IS NOT DISTINCT FROM r.return_date""",
    route_dates=_ROUTE, calendar_snapshot=_CALENDAR_SNAPSHOT))
def latest_calendar_fares(t):
    return ca.latest_calendar_fares(wr.upsert_calendar_snapshot(None, t.calendar_observations()), routes(t))


@query("calendar_trend", sql(f"""
SELECT subscription_id, observed_at::DATE AS bucket, min(price)::BIGINT AS lowest_price_minor,
  max(price)::BIGINT AS highest_price_minor, avg(price) AS average_price_minor, count(*) AS sample_count
FROM (SELECT subscription_id, run_id, max(observed_at) AS observed_at,
        min(CASE WHEN round_trip THEN total_price_minor ELSE lowest_price_minor END) AS price
  FROM route_dates r JOIN calobs o ON o.query_id = r.query_id AND o.currency = r.currency
    AND o.departure_date = r.departure_date AND o.return_date IS NOT DISTINCT FROM r.return_date
  WHERE observed_at BETWEEN {AS_OF} - INTERVAL 90 DAY AND {AS_OF}
    AND (NOT round_trip OR total_price_minor IS NOT NULL) GROUP BY 1, 2) GROUP BY 1, 2""", route_dates=_ROUTE))
def calendar_trend(t):
    since = window_start(NOW, 90)
    return ca.calendar_trend(t.calendar_observations(since, NOW), routes(t), since, NOW)


@query("calendar_page", sql("""
SELECT query_id, currency, departure_date, return_date, lowest_price_minor, total_price_minor, page_row,
  total > 10 AS has_more
FROM (SELECT s.*, count(*) OVER (PARTITION BY query_id) AS total,
    row_number() OVER (PARTITION BY query_id ORDER BY departure_date, return_date) AS page_row
  FROM calendar_snapshot s JOIN query q USING (query_id, currency)
  WHERE departure_date BETWEEN DATE '1998-07-05' AND DATE '1998-08-20'
    AND (return_date IS NOT NULL) = (trip_type = 'round_trip'))
WHERE page_row <= 10""", calendar_snapshot=_CALENDAR_SNAPSHOT))
def calendar_page(t):
    snapshot = wr.upsert_calendar_snapshot(None, t.calendar_observations())
    pages = ca.calendar_pages(snapshot, t.queries(), date(1998, 7, 5), date(1998, 8, 20), 10)
    return pages.drop("observed_at", "run_id", "direct_verified")


@query("calendar_second_page", sql("""
SELECT query_id, currency, departure_date, return_date, lowest_price_minor, total_price_minor, page_row - 10 AS page_row,
  total > 20 AS has_more
FROM (SELECT s.*, count(*) OVER (PARTITION BY query_id) AS total,
    row_number() OVER (PARTITION BY query_id ORDER BY departure_date, return_date) AS page_row
  FROM calendar_snapshot s JOIN query q USING (query_id, currency)
  WHERE departure_date BETWEEN DATE '1998-07-05' AND DATE '1998-08-20'
    AND (return_date IS NOT NULL) = (trip_type = 'round_trip'))
WHERE page_row BETWEEN 11 AND 20""", calendar_snapshot=_CALENDAR_SNAPSHOT))
def calendar_second_page(t):
    """One-way searches have no return dates: their cursors hold a null."""
    snapshot = wr.upsert_calendar_snapshot(None, t.calendar_observations())
    window = (date(1998, 7, 5), date(1998, 8, 20))
    first = ca.calendar_pages(snapshot, t.queries(), *window, 10)
    ends = first.where("has_more AND page_row = 10").select("query_id", "departure_date", "return_date")
    pages = ca.calendar_pages(snapshot, t.queries(), *window, 10, cursors=ends)
    return pages.drop("observed_at", "run_id", "direct_verified")


@query("low_fare_calendar", sql("""
SELECT query_id, currency, departure_date, strftime(departure_date, '%Y-%m') AS month, return_date,
  coalesce(total_price_minor, lowest_price_minor) AS price_minor
FROM calendar_snapshot QUALIFY row_number() OVER (PARTITION BY query_id, currency, departure_date
  ORDER BY coalesce(total_price_minor, lowest_price_minor), return_date NULLS FIRST) = 1""",
    calendar_snapshot=_CALENDAR_SNAPSHOT))
def low_fare_calendar(t):
    return ca.low_fare_calendar(wr.upsert_calendar_snapshot(None, t.calendar_observations()))


@query("date_pair_matrix", sql("""
SELECT query_id, currency, departure_date, return_date, price_minor,
  price_minor = min(price_minor) OVER (PARTITION BY query_id, currency) AS is_minimum
FROM (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id, currency ORDER BY departure_date) AS d
      FROM (SELECT query_id, currency, departure_date, return_date,
              min(coalesce(total_price_minor, lowest_price_minor)) AS price_minor
            FROM calendar_snapshot WHERE return_date IS NOT NULL GROUP BY ALL)) WHERE d <= 12
  QUALIFY dense_rank() OVER (PARTITION BY query_id, currency ORDER BY return_date) <= 12)""",
    calendar_snapshot=_CALENDAR_SNAPSHOT))
def date_pair_matrix(t):
    return ca.date_pair_matrix(wr.upsert_calendar_snapshot(None, t.calendar_observations()))


@query("market_snapshot", sql("""
SELECT * EXCLUDE (offer_fingerprint, itinerary_id, offer_id, run_id) FROM (
  SELECT l.origin, l.destination, l.departure_date AS service_date, s.*,
    row_number() OVER (PARTITION BY origin, destination
      ORDER BY total_price_minor, l.departure_date, query_id, is_direct) AS page_row
  FROM leg l JOIN snapshot s USING (query_id)
  WHERE position = 0 AND l.departure_date >= DATE '1998-06-30' AND l.departure_date < DATE '1998-06-30' + 180)
WHERE page_row <= 5""", snapshot=_PRICE_SNAPSHOT))
def market_snapshot(t):
    snapshot = wr.upsert_price_snapshot(None, t.observations())
    rows = la.market_snapshot(t.legs(), snapshot, NOW.date(), 5)
    return rows.drop("offer_fingerprint", "itinerary_id", "offer_id", "run_id")


@query("mark_lowest", sql("SELECT obs_id, run_id, currency, is_direct, total_price_minor, is_lowest FROM obs"))
def mark_lowest(t):
    return wr.mark_lowest(t.observations()).select(
        "obs_id", "run_id", "currency", "is_direct", "total_price_minor", "is_lowest")


@query("layover", sql("""
SELECT itinerary_id, leg_position, position,
  CASE WHEN next_departure >= arrival_utc THEN date_diff('minute', arrival_utc, next_departure) END AS layover_minutes,
  destination_terminal <> next_terminal AS terminal_change
FROM (SELECT *, lead(departure_utc) OVER w AS next_departure, lead(origin_terminal) OVER w AS next_terminal
  FROM segment WINDOW w AS (PARTITION BY itinerary_id, leg_position ORDER BY position))
WHERE next_departure IS NOT NULL"""))
def layover(t):
    return it.connections(t.segments())


@query("leg_summary", sql("""
SELECT itinerary_id, leg_position, CASE WHEN leg_position = 0 THEN 'outbound' ELSE 'inbound' END AS direction,
  arg_min(flight_number, position) AS flight_number, arg_min(marketing_airline, position) AS airline,
  arg_min(origin, position) AS origin, arg_max(destination, position) AS destination,
  min(departure_utc) AS departure_at, max(arrival_utc) AS arrival_at, count(*) - 1 AS stops,
  date_diff('minute', min(departure_utc), max(arrival_utc)) AS duration_minutes
FROM segment GROUP BY 1, 2"""))
def leg_summary(t):
    return it.leg_summary(t.segments())


@query("offer_detail", sql("""
SELECT offer_id, total_price_minor, currency, cabin, len(legs)::BIGINT AS leg_count,
  array_to_string(legs, ' | ') AS legs
FROM offer JOIN (SELECT itinerary_id, list(path ORDER BY leg_position) AS legs
  FROM (SELECT itinerary_id, leg_position, string_agg(flight_number || ':' || origin || '-' || destination, ', '
          ORDER BY position) AS path FROM segment GROUP BY 1, 2) GROUP BY 1) USING (itinerary_id)"""))
def offer_detail(t):
    nested = it.offer_detail(t.offers(), t.segments())
    path = F.transform("legs", lambda leg: F.array_join(F.transform(
        leg["segments"],
        lambda s: F.concat(s["flight_number"], F.lit(":"), s["origin"], F.lit("-"), s["destination"])), ", "))
    return nested.select(
        "offer_id", "total_price_minor", "currency", "cabin", F.size("legs").cast("bigint").alias("leg_count"),
        F.array_join(path, " | ").alias("legs"))
