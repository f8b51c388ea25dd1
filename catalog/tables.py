"""The fare tables themselves: both engines must see the same rows."""

from __future__ import annotations

from catalog.duck import sql
from catalog.registry import query


@query("table_runs", sql("""
SELECT run_id, query_id, status, attempt, scheduled_at, started_at, finished_at, lease_expires_at, error_code,
  upstream_status, partial_data FROM run"""))
def table_runs(t):
    return t.runs().drop("max_attempts", "on_demand_user_ids", "alerts_evaluated_at")


@query("table_segments", sql("""
SELECT itinerary_id, leg_position, position, marketing_airline, operating_airline, flight_number, origin,
  destination, origin_terminal, destination_terminal, departure_utc, arrival_utc, departure_local,
  arrival_local, duration_minutes FROM segment"""))
def table_segments(t):
    return t.segments().drop("run_id", "query_id", "departure_tz", "arrival_tz", "technical_stop_count")
