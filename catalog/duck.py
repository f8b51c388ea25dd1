"""The fare tables as DuckDB expressions, for the SQL checks."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '1998-06-30 12:00:00'"
_AIRPORTS = "['PVG','NRT','ICN','SIN','HKG','BKK','KUL','TPE']"
_HOURS = "[8,9,9,8,8,7,8,8]"
_AIRLINES = "['MU','CA','JL','NH']"

TABLES = {
    "run0": """
  SELECT o_orderkey AS run_id, o_custkey // 16 AS query_id,
    CASE WHEN o_orderstatus <> 'P' THEN 'succeeded'
         WHEN o_orderkey % 10 < 3 AND o_orderdate::DATE NOT BETWEEN DATE '1998-06-27' AND DATE '1998-07-01'
           AND o_custkey % 64 <> 3 THEN 'failed'
         WHEN o_orderkey % 10 = 0 THEN 'pending'
         WHEN o_orderkey % 10 = 1 THEN 'leased' WHEN o_orderkey % 10 = 2 THEN 'running'
         WHEN o_orderkey % 10 = 3 THEN 'canceled' ELSE 'failed' END AS status,
    o_orderdate + to_minutes(o_orderkey % 1440) AS clock, o_orderstatus = 'F' AS evaluated,
    o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders""",
    "run": """
  SELECT run_id, query_id, status, 1 + o_orderkey % 3 AS attempt, 3::BIGINT AS max_attempts,
    CASE WHEN status = 'pending' AND o_orderkey % 20 = 0 THEN clock + INTERVAL 30 MINUTE
         ELSE clock - INTERVAL 10 MINUTE END AS scheduled_at,
    CASE WHEN status IN ('running','succeeded','failed','canceled')
         THEN clock - to_minutes(o_orderkey % 7 + 1) END AS started_at,
    CASE WHEN status IN ('succeeded','failed','canceled') THEN clock END AS finished_at,
    CASE WHEN status IN ('leased','running') THEN clock + INTERVAL 15 MINUTE END AS lease_expires_at,
    CASE WHEN status = 'failed' THEN 'err_' || substr(o_orderpriority, 1, 1) END AS error_code,
    CASE WHEN status = 'succeeded' AND o_orderpriority = '5-LOW' THEN 'success_with_warnings'
         WHEN status = 'succeeded' THEN 'success' END AS upstream_status,
    o_orderkey % 2 = 0 AS partial_data,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey % 25 END AS on_demand_user,
    CASE WHEN evaluated THEN clock END AS alerts_evaluated_at, evaluated FROM run0""",
    "line": """
  SELECT l.*, r.run_id, r.query_id, r.clock, r.evaluated,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS itinerary_id,
    (l_linenumber % 3)::BIGINT AS stops, CASE WHEN query_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS leg_count,
    round(l_extendedprice * 100)::BIGINT AS price,
    CASE WHEN l_partkey % 50 = 49 THEN 'USD' WHEN query_id % 5 = 4 THEN 'JPY' ELSE 'CNY' END AS money
  FROM lineitem l JOIN run0 r ON l_orderkey = run_id WHERE status = 'succeeded'""",
    "itinerary": """
  SELECT itinerary_id, run_id, query_id, 120 + (l_quantity * 10)::BIGINT AS total_duration_minutes,
    stops AS stop_count, stops = 0 AS is_direct, leg_count FROM line""",
    "offer": """
  SELECT itinerary_id AS offer_id, run_id, query_id, itinerary_id, 'economy' AS cabin, money AS currency,
    price AS total_price_minor, price * 4 // 5 AS base_price_minor, price - price * 4 // 5 AS tax_minor,
    l_linenumber::BIGINT AS seats_remaining FROM line""",
    "obs": """
  SELECT itinerary_id AS obs_id, clock AS observed_at, query_id, run_id, itinerary_id,
    itinerary_id AS offer_id, md5(itinerary_id) AS offer_fingerprint, money AS currency,
    price AS total_price_minor, stops = 0 AS is_direct,
    price = min(price) OVER (PARTITION BY run_id, money, stops = 0) AS is_lowest FROM line""",
    "segment": f"""
  SELECT *, {_AIRLINES}[(l_suppkey + position) % 4 + 1] AS marketing_airline,
    {_AIRLINES}[(l_partkey + position) % 4 + 1] AS operating_airline,
    {_AIRLINES}[(l_suppkey + position) % 4 + 1] || (100 + l_partkey % 900) AS flight_number,
    {_AIRPORTS}[from_node % 8 + 1] AS origin, {_AIRPORTS}[to_node % 8 + 1] AS destination,
    CASE WHEN l_suppkey % 3 > 0 THEN 'T' || (hop % 2 + 1) END AS origin_terminal,
    'T' || (l_partkey % 2 + 1) AS destination_terminal,
    departure_utc + to_minutes(duration_minutes) AS arrival_utc,
    departure_utc + to_hours({_HOURS}[from_node % 8 + 1]) AS departure_local,
    departure_utc + to_minutes(duration_minutes) + to_hours({_HOURS}[to_node % 8 + 1]) AS arrival_local
  FROM (SELECT *, l_suppkey + (CASE WHEN leg_position = 0 THEN hop ELSE stops + 1 - hop END)
                  * (1 + l_partkey % 3) AS from_node,
      l_suppkey + (CASE WHEN leg_position = 0 THEN hop + 1 ELSE stops - hop END) * (1 + l_partkey % 3) AS to_node,
      l_shipdate + to_days((leg_position * 7)::INT) + to_minutes((l_partkey * 7) % 1440 + hop * 240) AS departure_utc,
      90 + l_partkey % 60 AS duration_minutes
    FROM (SELECT *, position // (stops + 1) AS leg_position, position % (stops + 1) AS hop
      FROM (SELECT *, unnest(range(leg_count * (stops + 1))) AS position FROM line)))""",
    "calobs": """
  SELECT clock AS observed_at, query_id, run_id, DATE '1998-07-01' + (l_partkey % 60)::INT AS departure_date,
    CASE WHEN leg_count = 2 THEN DATE '1998-07-08' + (l_partkey % 60)::INT END AS return_date,
    CASE WHEN query_id % 5 = 4 THEN 'JPY' ELSE 'CNY' END AS currency, price AS lowest_price_minor,
    CASE WHEN l_linenumber <> 7 THEN price + price // 10 END AS total_price_minor,
    itinerary_id AS fingerprint FROM line""",
    "query": """
  SELECT DISTINCT c_custkey // 16 AS query_id,
    CASE WHEN (c_custkey // 16) % 4 = 3 THEN 'beta' ELSE 'alpha' END AS provider,
    md5((c_custkey // 16)::VARCHAR) AS query_hash,
    CASE WHEN (c_custkey // 16) % 3 = 0 THEN 'round_trip' ELSE 'one_way' END AS trip_type,
    CASE WHEN (c_custkey // 16) % 5 = 4 THEN 'JPY' ELSE 'CNY' END AS currency,
    (c_custkey // 16) % 2 = 0 AS direct_only FROM customer""",
    "leg": f"""
  SELECT query_id, position, {_AIRPORTS}[(query_id + position * 3) % 8 + 1] AS origin,
    {_AIRPORTS}[(query_id + (1 - position) * 3) % 8 + 1] AS destination,
    DATE '1998-07-01' + (query_id % 60 + position * 7)::INT AS departure_date
  FROM (SELECT *, unnest(CASE WHEN trip_type = 'round_trip' THEN [0, 1] ELSE [0] END)::BIGINT AS position
        FROM query)""",
    "sub": """
  SELECT c_custkey AS subscription_id, c_nationkey::BIGINT AS user_id, c_custkey // 16 AS query_id,
    c_name AS name, c_custkey % 10 <> 9 AS enabled, 3600 * (1 + c_custkey % 6) AS poll_interval_seconds,
    CASE WHEN c_custkey % 17 > 0 THEN TIMESTAMP '1998-06-30 12:00:00'
         + to_minutes((c_custkey * 37) % 2880 - 1440) END AS next_due_at,
    TIMESTAMP '1998-01-01 00:00:00' + to_seconds(c_custkey) AS created_at FROM customer""",
    "filter": """
  SELECT c_custkey AS subscription_id,
    CASE WHEN c_custkey % 4 = 0 THEN ['MU'] WHEN c_custkey % 4 = 1 THEN ['CA','NH'] ELSE []::VARCHAR[] END AS airline_codes,
    CASE WHEN c_custkey % 9 = 0 THEN ['PVG','NRT','ICN'] ELSE []::VARCHAR[] END AS departure_airports,
    CASE WHEN c_custkey % 11 = 0 THEN ['SIN','HKG','BKK'] ELSE []::VARCHAR[] END AS arrival_airports,
    CASE WHEN c_custkey % 7 = 0 THEN 4000000 END AS max_price_minor,
    CASE WHEN c_custkey % 5 = 0 THEN 1 END AS max_stops,
    CASE WHEN c_custkey % 6 = 0 THEN 400 END AS max_duration_minutes,
    CASE WHEN c_custkey % 8 = 0 THEN 360 WHEN c_custkey % 16 = 5 THEN 300 END AS departure_minute_start,
    CASE WHEN c_custkey % 8 = 0 THEN 1080 END AS departure_minute_end FROM customer""",
    "context": """
  SELECT s.*, q.provider, q.query_hash, q.trip_type, q.currency, q.direct_only, f.* EXCLUDE (subscription_id),
    (len(airline_codes) > 0 OR len(departure_airports) > 0 OR len(arrival_airports) > 0 OR max_stops IS NOT NULL
     OR max_duration_minutes IS NOT NULL OR departure_minute_start IS NOT NULL
     OR departure_minute_end IS NOT NULL) AS needs_scan
  FROM sub s JOIN query q USING (query_id) JOIN filter f USING (subscription_id)""",
    "feature": """
  SELECT i.itinerary_id, any_value(i.query_id) AS query_id, any_value(stop_count) AS stop_count,
    any_value(is_direct) AS is_direct, any_value(total_duration_minutes) AS total_duration_minutes,
    list(DISTINCT marketing_airline) AS airlines,
    max(origin) FILTER (leg_position = 0 AND position = 0) AS first_origin,
    max(hour(departure_local) * 60 + minute(departure_local))
      FILTER (leg_position = 0 AND position = 0) AS first_minute,
    arg_max(destination, position) FILTER (leg_position = 0) AS last_destination
  FROM itinerary i JOIN segment s USING (itinerary_id) GROUP BY i.itinerary_id""",
    # every offer price that passes the filter of a subscription
    "passing": """
  SELECT c.subscription_id, o.* FROM context c
  JOIN obs o ON o.query_id = c.query_id AND o.currency = c.currency
  JOIN feature f ON f.itinerary_id = o.itinerary_id
  WHERE (NOT c.direct_only OR f.is_direct)
    AND (c.max_price_minor IS NULL OR o.total_price_minor <= c.max_price_minor)
    AND (c.max_stops IS NULL OR f.stop_count <= c.max_stops)
    AND (c.max_duration_minutes IS NULL OR f.total_duration_minutes <= c.max_duration_minutes)
    AND (len(c.airline_codes) = 0 OR list_has_any(f.airlines, c.airline_codes))
    AND (len(c.departure_airports) = 0 OR list_contains(c.departure_airports, f.first_origin))
    AND (c.departure_minute_start IS NULL OR c.departure_minute_end IS NULL
         OR (f.first_minute >= c.departure_minute_start AND f.first_minute < c.departure_minute_end))
    AND (len(c.arrival_airports) = 0 OR list_contains(c.arrival_airports, f.last_destination))""",
    "sample": """
  SELECT subscription_id, query_id, currency, run_id, observed_at, min(total_price_minor) AS price
  FROM passing GROUP BY ALL""",
    # exact samples of maintained daily rows
    "floor": """
  SELECT query_id, currency, run_id, observed_at, m.direct_only, min(total_price_minor) AS price
  FROM obs JOIN (VALUES (false), (true)) m(direct_only) ON (NOT m.direct_only OR is_direct)
  WHERE is_lowest GROUP BY ALL""",
    "daily": """
  SELECT query_id, observed_at::DATE AS observation_date, currency, direct_only,
    min(price)::BIGINT AS lowest_price_minor, max(price)::BIGINT AS highest_price_minor,
    sum(price)::BIGINT AS price_sum_minor, count(*) AS sample_count,
    min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at
  FROM floor GROUP BY ALL""",
    "rule": """
  SELECT c_custkey AS rule_id, c_nationkey::BIGINT AS user_id, c_custkey AS subscription_id,
    ['price_threshold','new_low','percentage_drop','absolute_drop','direct_available','round_trip_range',
     'data_stale'][(c_custkey // 3) % 7 + 1] AS rule_type, c_custkey % 13 <> 5 AS rule_enabled,
    CASE WHEN c_acctbal >= 0 THEN round(c_acctbal * 100)::BIGINT * 4 END AS threshold_price_minor,
    CASE WHEN c_custkey % 12 = 4 THEN 'usd' END AS threshold_currency,
    500 + (c_custkey % 10) * 100 AS threshold_percentage,
    CASE WHEN c_custkey % 2 = 0 THEN 365 END AS comparison_window_days,
    86400 * (c_custkey % 3) AS cooldown_seconds,
    CASE WHEN c_custkey % 4 > 0 THEN 1000000 ELSE -1 END AS config_min_price,
    CASE WHEN c_custkey % 5 > 0 THEN 3000000 END AS config_max_price,
    CASE WHEN c_custkey % 3 = 0 THEN 'subscription_target_price' ELSE 'manual' END AS config_source,
    TIMESTAMP '1998-01-02 00:00:00' + to_seconds(c_custkey) AS rule_created_at FROM customer""",
    "channel": """
  SELECT user_id * 3 + slot AS channel_id, user_id, ['email','webhook','chat'][slot + 1] AS kind,
    (user_id + slot) % 4 > 0 AS enabled, ['Asia/Shanghai','Asia/Tokyo','UTC'][user_id % 3 + 1] AS timezone,
    CASE WHEN slot > 0 THEN 1320 END AS quiet_start_minute, CASE WHEN slot > 0 THEN 480 END AS quiet_end_minute,
    slot = 2 AS weekdays_only
  FROM (SELECT n_nationkey::BIGINT AS user_id, unnest([0, 1, 2])::BIGINT AS slot FROM nation)""",
    "rule_channel": """
  SELECT c_custkey AS rule_id, (c_nationkey * 3 + c_custkey % 3)::BIGINT AS channel_id
  FROM customer WHERE c_acctbal >= 4000""",
    "alert_event": """
  SELECT run_id AS event_id, o_custkey AS rule_id, o_custkey % 25 AS user_id, run_id, clock AS created_at
  FROM run0 WHERE status = 'failed'""",
    "delivery": """
  SELECT run_id AS delivery_id, run_id AS event_id, o_custkey % 75 AS channel_id,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'failed' WHEN '3' THEN 'sending'
      WHEN '4' THEN 'succeeded' ELSE 'canceled' END AS status, o_orderkey % 6 AS attempt_count,
    CASE WHEN o_orderkey % 4 > 0 THEN clock + INTERVAL 1 HOUR END AS next_attempt_at, clock AS updated_at
  FROM run0""",
    "export_job": """
  SELECT run_id AS job_id, o_custkey % 25 AS user_id,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'running' WHEN '3' THEN 'succeeded'
      WHEN '4' THEN 'expired' ELSE 'failed' END AS status,
    CASE WHEN o_orderkey % 3 > 0 THEN 'export-' || o_orderkey END AS file_name,
    CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice)::BIGINT END AS size_bytes, clock AS created_at
  FROM run0""",
    "view_item": """
  SELECT c_custkey // 5 AS view_id, c_custkey % 5 AS position,
    CASE WHEN c_custkey % 11 > 0 THEN c_custkey END AS subscription_id,
    [7, 30, 90, 14][(c_custkey // 5) % 4 + 1]::BIGINT AS trend_days,
    2 + (c_custkey // 5) % 5 AS configured_route_count FROM customer""",
    "event": """
  SELECT event_id, ts AS observed_at, user_id AS query_id, event_type,
    round(value * 100)::BIGINT AS price_minor, props FROM events""",
}

_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def _needed(text: str, order: dict[str, None], open_names: frozenset[str] = frozenset()) -> None:
    for name in dict.fromkeys(_WORD.findall(text)):
        if name in TABLES and name not in order and name not in open_names:
            _needed(TABLES[name], order, open_names | {name})
            order[name] = None


def sql(body: str, **extra: str) -> str:
    """``body`` with the definitions of the fare tables that it reads in front.

    ``extra`` adds definitions of its own, in the given order.
    """
    seen: dict[str, None] = {}
    _needed(body + " ".join(extra.values()), seen)
    parts = [f"{name} AS ({TABLES[name]})" for name in seen]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
