"""Comparison views and the reports over all users."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalog import latest as cl
from catalog import runs as cr
from catalog import trends as ct
from catalog.duck import AS_OF, sql
from catalog.history import contexts, samples
from catalog.registry import query
from skyledger.functions.times import window_start
from skyledger.operators import alerts as al
from skyledger.operators import calendars as ca
from skyledger.operators import compare as co
from skyledger.operators import itineraries as it
from skyledger.operators import latest as la
from skyledger.operators import runs as ru
from skyledger.operators import trends as tr
from skyledger.operators import writes as wr
from skyledger.operators.paging import first_pages, least
from skyledger.plans import reports as re
from skyledger.sources.testdata import AS_OF as NOW


@query("view_state", sql("""
SELECT view_id, count(subscription_id) AS active_routes,
  greatest(0, configured_route_count - count(subscription_id)) AS missing_routes, count(subscription_id) >= 2 AS comparable
FROM view_item GROUP BY view_id, configured_route_count"""))
def view_state(t):
    return co.view_state(t.comparison_items(), t.subscriptions())


@query("validate_views", sql("""
SELECT view_id, count(*) AS routes, CASE WHEN count(*) < 2 THEN 'too_few_routes'
  WHEN count(DISTINCT currency) > 1 THEN 'currencies_differ'
  WHEN trend_days NOT IN (7, 30, 90) THEN 'invalid_trend_days' END AS problem
FROM view_item JOIN context USING (subscription_id) GROUP BY view_id, trend_days"""))
def validate_views(t):
    return co.validate_views(t.comparison_items(), contexts(t))


def detailed_trends(t):
    rows, points = ct.raw_points(t)
    return tr.route_trend(points, rows)


def calendar_trends(t):
    since = window_start(NOW, 90)
    return ca.calendar_trend(t.calendar_observations(since, NOW), cl.routes(t), since, NOW)


_DETAIL = f"""SELECT subscription_id, observed_at::DATE AS bucket, min(price) AS low FROM sample
  WHERE {ct._IN_RANGE} GROUP BY ALL"""
_PLACES = ", ".join(f"min(low) FILTER (position = {p}) AS route_{p}" for p in range(8))


@query("align_trends", sql(f"SELECT view_id, bucket, {_PLACES} FROM view_item JOIN detail USING (subscription_id) GROUP BY 1, 2",
                           detail=_DETAIL))
def align_trends(t):
    return co.align_trends(t.comparison_items(), detailed_trends(t))


@query("preferred_track", sql(f"""
SELECT view_id, CASE WHEN bool_or(coalesce(d, false)) OR NOT bool_or(coalesce(c, false)) THEN 'detailed' ELSE 'calendar' END
  AS track
FROM view_item LEFT JOIN (SELECT DISTINCT subscription_id, true AS d FROM detail) USING (subscription_id)
LEFT JOIN (SELECT DISTINCT subscription_id, true AS c FROM route_dates r JOIN calobs o ON o.query_id = r.query_id
    AND o.currency = r.currency AND o.departure_date = r.departure_date
    AND o.return_date IS NOT DISTINCT FROM r.return_date
  WHERE observed_at BETWEEN {AS_OF} - INTERVAL 90 DAY AND {AS_OF}
    AND (NOT round_trip OR total_price_minor IS NOT NULL)) USING (subscription_id) GROUP BY 1""",
    detail=_DETAIL, route_dates=cl._ROUTE))
def preferred_track(t):
    return co.preferred_track(t.comparison_items(), detailed_trends(t), calendar_trends(t))


def snapshot(t):
    """Comparison rows as of the newest runs; trend numbers as of the fixed time."""
    rows, passing = cl.passing_latest(t)
    states = re.route_states(rows, la.latest_fares(passing, rows), datetime(2001, 8, 1))
    _, points = ct.raw_points(t)
    _, minima = samples(t, NOW - timedelta(hours=48), NOW)
    summaries = tr.route_summary(points, minima, rows, NOW)
    fares = ca.latest_calendar_fares(wr.upsert_calendar_snapshot(None, t.calendar_observations()), cl.routes(t))
    return re.comparison_snapshot(t.comparison_items(), states, summaries, fares)


_BEST = """SELECT subscription_id, total_price_minor AS latest_price_minor, finished_at AS latest_observed_at
  FROM latest_pass
  QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY total_price_minor, offer_id) = 1"""
_PERIOD = f"""SELECT subscription_id, min(price) AS minimum_price_minor, max(price) AS maximum_price_minor,
  sum(price)::DOUBLE / count(*) AS average_price_minor, count(*) AS n FROM sample WHERE {ct._IN_RANGE} GROUP BY 1"""
_CAL_FARE = """SELECT subscription_id, CASE WHEN round_trip THEN total_price_minor ELSE lowest_price_minor END
    AS calendar_price_minor, CASE WHEN round_trip THEN 'round_trip_total' ELSE 'one_way_lowest' END AS calendar_basis,
    s.observed_at AS calendar_observed_at
  FROM route_dates r JOIN calendar_snapshot s ON s.query_id = r.query_id AND s.currency = r.currency
    AND s.departure_date = r.departure_date AND s.return_date IS NOT DISTINCT FROM r.return_date"""
_SNAPSHOT = f"""
SELECT view_id, position, c.subscription_id, enabled, trip_type, c.currency, direct_only, latest_price_minor,
  latest_observed_at, CASE WHEN latest_observed_at IS NULL THEN 'unavailable'
    WHEN TIMESTAMP '2001-08-01' - latest_observed_at > greatest(INTERVAL 1 HOUR, to_seconds(2 * poll_interval_seconds))
    THEN 'stale' ELSE 'current' END AS price_status,
  minimum_price_minor, maximum_price_minor, average_price_minor, coalesce(n, 0) AS sample_count,
  CASE WHEN n > 0 THEN {ct._PERCENT} END AS price_change_percent, calendar_price_minor, calendar_basis, calendar_observed_at
FROM view_item JOIN context c USING (subscription_id) LEFT JOIN best USING (subscription_id)
LEFT JOIN period USING (subscription_id) LEFT JOIN change USING (subscription_id)
LEFT JOIN cal_fare USING (subscription_id)"""
_SNAPSHOT_PARTS = {
    "latest_run": cl._LATEST_RUN, "latest_pass": cl._PASSING, "best": _BEST, "period": _PERIOD,
    "change": ct._CHANGE.format(key="subscription_id,", source="sample"),
    "route_dates": cl._ROUTE, "calendar_snapshot": cl._CALENDAR_SNAPSHOT, "cal_fare": _CAL_FARE,
}


@query("comparison_snapshot", sql(_SNAPSHOT, **_SNAPSHOT_PARTS))
def comparison_snapshot(t):
    return snapshot(t)


_SERIES = """(SELECT subscription_id, string_agg(strftime(bucket, '%Y-%m-%d') || ':' || low, ',' ORDER BY bucket)
    FILTER (bucket >= {as_of}::DATE - trend_days::INT) AS points FROM {source} JOIN view_item USING (subscription_id)
    GROUP BY subscription_id)"""
_CALENDAR_DAYS = f"""
SELECT subscription_id, observed_at::DATE AS bucket, min(price)::BIGINT AS low
FROM (SELECT subscription_id, run_id, max(observed_at) AS observed_at,
        min(CASE WHEN round_trip THEN total_price_minor ELSE lowest_price_minor END) AS price
  FROM route_dates r JOIN calobs o ON o.query_id = r.query_id AND o.currency = r.currency
    AND o.departure_date = r.departure_date AND o.return_date IS NOT DISTINCT FROM r.return_date
  WHERE observed_at BETWEEN {AS_OF} - INTERVAL 90 DAY AND {AS_OF}
    AND (NOT round_trip OR total_price_minor IS NOT NULL) GROUP BY 1, 2) GROUP BY 1, 2"""


@query("comparison_series", sql(f"""
SELECT view_id, v.position, v.subscription_id, origin, destination, l.departure_date, return_date,
  coalesce(d.points, '') AS detailed_points, coalesce(k.points, '') AS calendar_points
FROM view_item v JOIN context c USING (subscription_id)
LEFT JOIN (SELECT query_id, arg_min(origin, position) AS origin, arg_min(destination, position) AS destination,
    arg_min(departure_date, position) AS departure_date, max(departure_date) FILTER (position = 1) AS return_date
  FROM leg GROUP BY 1) l USING (query_id)
LEFT JOIN {_SERIES.format(as_of=AS_OF, source="detail")} d USING (subscription_id)
LEFT JOIN {_SERIES.format(as_of=AS_OF, source="calendar_day")} k USING (subscription_id)""",
    detail=_DETAIL, route_dates=cl._ROUTE, calendar_day=_CALENDAR_DAYS))
def comparison_series(t):
    rows = re.comparison_series(
        t.comparison_items(), contexts(t), t.legs(), detailed_trends(t), calendar_trends(t), NOW)
    for name in ("detailed_points", "calendar_points"):
        text = F.transform(name, lambda x: F.concat(
            F.date_format(x["bucket"], "yyyy-MM-dd"), F.lit(":"), x["lowest_price_minor"].cast("string")))
        rows = rows.withColumn(name, F.array_join(text, ","))
    return rows


def _place(mode: str) -> str:
    column, descending = co.SORTS[mode]
    order = "position" if column is None else f"{column} {'DESC' if descending else 'ASC'} NULLS LAST, position"
    return f"row_number() OVER (PARTITION BY view_id ORDER BY {order}) AS {_column_of(mode)}"


def _column_of(mode: str) -> str:
    return "by_" + mode.replace("-", "_")


@query("sort_routes", sql(f"""SELECT view_id, subscription_id, {", ".join(map(_place, co.SORTS))}
FROM (SELECT *, CASE price_status WHEN 'current' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END AS freshness FROM snap)""",
    **_SNAPSHOT_PARTS, snap=_SNAPSHOT))
def sort_routes(t):
    rows = snapshot(t)
    for mode in co.SORTS:
        rows = co.sort_routes(rows, mode).withColumnRenamed("place", _column_of(mode))
    return rows.select("view_id", "subscription_id", *map(_column_of, co.SORTS))


@query("dashboard_overview", sql(f"""
SELECT s.user_id, active_subscriptions, routes_tracked, success_rate_24h, lowest_price_minor, price_change_percent
FROM (SELECT user_id, count(*) FILTER (enabled) AS active_subscriptions, count(DISTINCT query_id) AS routes_tracked
      FROM sub GROUP BY 1) s
LEFT JOIN (SELECT user_id, CASE WHEN count(*) FILTER (recent) > 0 THEN count(*) FILTER (recent AND status = 'succeeded')::DOUBLE
      / (count(*) FILTER (recent))::DOUBLE * 100.0 END AS success_rate_24h
    FROM (SELECT *, coalesce(status IN ('succeeded','failed','canceled')
      AND finished_at BETWEEN {AS_OF} - INTERVAL 24 HOUR AND {AS_OF}, false) AS recent FROM visible) GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT user_id, CASE WHEN count(DISTINCT currency) = 1 THEN min(latest_price_minor) END AS lowest_price_minor
    FROM best JOIN context USING (subscription_id) GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT user_id, {ct._PERCENT} AS price_change_percent FROM change) USING (user_id)""",
    visible=cr._VISIBLE.format(where="AND s.enabled"), latest_run=cl._LATEST_RUN, latest_pass=cl._PASSING, best=_BEST,
    change=ct._CHANGE.format(key="c.user_id,", source="""context c JOIN sample s
      ON s.subscription_id = c.subscription_id AND c.enabled AND c.currency = 'CNY'""")))
def dashboard_overview(t):
    rows, passing = cl.passing_latest(t)
    latest = la.latest_fares(passing, rows).join(rows.select("subscription_id", "user_id"), "subscription_id")
    _, minima = samples(t, NOW - timedelta(hours=48), NOW)
    return re.dashboard_overview(
        ru.subscription_counts(t.subscriptions()),
        ru.collection_health(t.runs(), t.subscriptions(), NOW),
        la.lowest_route_price(latest), tr.dashboard_change(minima, rows, "CNY", NOW))


@query("dashboard_view", sql(f"""
SELECT s.user_id, active_subscriptions, coalesce(trend, '') AS trend, coalesce(routes, '') AS routes
FROM (SELECT user_id, count(*) FILTER (enabled) AS active_subscriptions FROM sub GROUP BY 1) s
LEFT JOIN (SELECT user_id, string_agg(strftime(bucket, '%Y-%m-%d') || ':' || low || ':' || n, ',' ORDER BY bucket) AS trend
  FROM (SELECT user_id, observed_at::DATE AS bucket, min(price)::BIGINT AS low, count(*) AS n FROM branch_sample GROUP BY ALL)
  GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT user_id, string_agg(subscription_id || ':' || coalesce(low::VARCHAR, '-') || ':' || n, ',' ORDER BY subscription_id)
    AS routes
  FROM (SELECT c.user_id, c.subscription_id, min(price)::BIGINT AS low, count(price) AS n
    FROM context c LEFT JOIN (SELECT * FROM sample WHERE {ct._IN_RANGE}) p USING (subscription_id) GROUP BY ALL)
  GROUP BY 1) USING (user_id)""", branch_sample=ct._BRANCH_SAMPLE))
def dashboard_view(t):
    """One set of priced points gives the trend of a user and the numbers of the routes."""
    rows, points = ct.raw_points(t)
    _, minima = samples(t, NOW - timedelta(hours=48), NOW)
    owners = rows.select("subscription_id", "user_id")
    routes = tr.route_summary(points, minima, rows, NOW).join(owners, "subscription_id")
    counts = ru.subscription_counts(t.subscriptions()).select("user_id", "active_subscriptions")
    view = re.dashboard_view(counts, tr.dashboard_trend(points, rows, "CNY"), routes)
    day = F.transform("trend", lambda x: F.concat_ws(
        ":", F.date_format(x["bucket"], "yyyy-MM-dd"), x["lowest_price_minor"].cast("string"), x["sample_count"].cast("string")))
    route = F.transform("routes", lambda x: F.concat_ws(
        ":", x["subscription_id"].cast("string"), F.coalesce(x["minimum_price_minor"].cast("string"), F.lit("-")),
        x["sample_count"].cast("string")))
    return view.select("user_id", "active_subscriptions", F.array_join(day, ",").alias("trend"), F.array_join(route, ",").alias("routes"))


@query("subscription_view", sql(f"""
SELECT user_id, subscription_id, page_row, trip_type, max_stops::BIGINT AS max_stops, target_price_minor, legs FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, subscription_id DESC) AS page_row
  FROM context WHERE created_at <= {AS_OF})
JOIN (SELECT query_id, string_agg(origin || '-' || destination || ' ' || departure_date, ', ' ORDER BY position) AS legs
  FROM leg GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT subscription_id, threshold_price_minor AS target_price_minor FROM rule
  WHERE rule_type = 'price_threshold' AND config_source = 'subscription_target_price') USING (subscription_id)
WHERE page_row <= 20"""))
def subscription_view(t):
    rows = re.subscription_view(contexts(t), t.legs(), al.target_prices(t.alert_rules()), NOW)
    text = F.transform("legs", lambda x: F.concat(
        x["origin"], F.lit("-"), x["destination"], F.lit(" "), x["departure_date"].cast("string")))
    return rows.select("user_id", "subscription_id", "page_row", "trip_type", "max_stops", "target_price_minor",
                       F.array_join(text, ", ").alias("legs"))


@query("rule_view", sql("""
SELECT user_id, rule_id, rule_type, page_row, coalesce(channels, '') AS channels FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rule_created_at DESC, rule_id DESC) AS page_row FROM rule)
LEFT JOIN (SELECT rule_id, string_agg(channel_id::VARCHAR, ',' ORDER BY channel_id) AS channels
  FROM rule_channel GROUP BY 1) USING (rule_id) WHERE page_row <= 20"""))
def rule_view(t):
    ids = F.transform("channels", lambda c: c["channel_id"].cast("string"))
    return re.rule_view(t.alert_rules(), t.rule_channels()).select(
        "user_id", "rule_id", "rule_type", "page_row", F.array_join(ids, ",").alias("channels"))


@query("operations_view", sql(f"""
SELECT c.*, coalesce(n, 0) AS new_shapes, coalesce(k, 0) AS current_shapes, coalesce(h, 0) AS historical_shapes
FROM (SELECT user_id, count(*) FILTER (status = 'pending' AND scheduled_at <= {AS_OF}) AS ready,
    count(*) FILTER (status = 'pending' AND scheduled_at > {AS_OF}) AS retrying,
    count(*) FILTER (status = 'leased') AS leased, count(*) FILTER (status = 'running') AS running,
    count(*) FILTER (status = 'failed' AND finished_at >= {AS_OF} - INTERVAL 24 HOUR) AS failed_24h
  FROM visible GROUP BY 1) c
LEFT JOIN (SELECT DISTINCT user_id, provider FROM context WHERE provider = 'alpha') p USING (user_id)
LEFT JOIN (SELECT provider, count(*) FILTER (state = 'new') AS n, count(*) FILTER (state = 'current') AS k,
    count(*) FILTER (state = 'historical') AS h
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY provider, endpoint ORDER BY last_seen_at DESC) > 1
      THEN 'historical' WHEN first_seen_at >= TIMESTAMP '2024-01-01 12:00:00' THEN 'new' ELSE 'current' END AS state FROM shape)
  GROUP BY 1) USING (provider)""".replace("c.*, coalesce", "c.*, coalesce"),
    visible=cr._VISIBLE.format(where=""), shape=cr._SHAPES))
def operations_view(t):
    signals = ru.shape_signals(cr.shapes(t), datetime(2024, 1, 2, 12))
    counts = ru.run_status_counts(t.runs(), t.subscriptions(), NOW)
    return re.operations_view(counts, signals, t.subscriptions(), t.queries())


_DIRECTORY = """SELECT CASE WHEN n_regionkey = 4 THEN 'OLD_' ELSE 'NATION_' END || n_nationkey AS code, r_name AS city, 'Port ' || n_nationkey AS name,
  CASE WHEN n_nationkey % 2 = 0 THEN 'city' ELSE 'airport' END AS kind FROM nation JOIN region ON n_regionkey = r_regionkey"""


def directory(t):
    return t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "concat(CASE WHEN n_regionkey = 4 THEN 'OLD_' ELSE 'NATION_' END, n_nationkey) AS code", "r_name AS city", "concat('Port ', n_nationkey) AS name",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'city' ELSE 'airport' END AS kind", "r_name AS country",
        "array(concat('alias ', n_nationkey % 3), lower(n_name)) AS aliases")


@query("readable_location", sql("""
SELECT c_custkey, CASE WHEN code IS NULL THEN raw WHEN kind = 'city' THEN name || ' · ' || code
  ELSE city || ' · ' || name || ' (' || code || ')' END AS place
FROM (SELECT c_custkey, 'NATION_' || c_nationkey AS raw FROM customer) LEFT JOIN directory ON code = raw""",
    directory=_DIRECTORY))
def readable_location(t):
    rows = t.raw("customer").selectExpr("c_custkey", "concat(' nation_', c_nationkey, ' ') AS code_text")
    return it.readable_location(rows, directory(t), "code_text", "place").select("c_custkey", "place")


@query("location_search", sql("""
SELECT code, name FROM directory WHERE contains(lower(code), 'nation_1') OR contains(lower(city), 'nation_1')
  OR contains(lower(name), 'nation_1') OR contains('nation_' || substr(name, 6), 'nation_1')""", directory=_DIRECTORY))
def location_search(t):
    return it.location_search(directory(t), " Nation_1").select("code", "name")


@query("view_page", sql("""
SELECT user_id, view_id, created_at, page_row, has_more FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, view_id DESC) AS page_row,
    count(*) OVER (PARTITION BY user_id) > 10 AS has_more
  FROM (SELECT view_id, user_id, created_at FROM view_item v JOIN sub s ON s.subscription_id = v.view_id * 5
        WHERE position = 0)) WHERE page_row <= 10"""))
def view_page(t):
    """A view belongs to the owner of its first route."""
    routes = t.subscriptions().selectExpr("subscription_id div 5 AS view_id", "subscription_id", "user_id", "created_at")
    owners = least(routes, ["view_id"], ["subscription_id"], ["user_id", "created_at"])
    views = t.comparison_items().select("view_id").distinct().join(owners, "view_id")
    return first_pages(views, ["user_id"], ["created_at", "view_id"], 10, descending=True).select(
        "user_id", "view_id", "created_at", "page_row", "has_more")
