"""Alert rules, events and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.duck import AS_OF, sql
from catalog.history import contexts
from catalog.registry import query
from skyledger.operators import alerts as al
from skyledger.operators import delivery as de
from skyledger.operators import filters as fl
from skyledger.operators.paging import first_pages
from skyledger.session import cut_lineage
from skyledger.skew import fits_broadcast
from skyledger.sources.testdata import AS_OF as NOW

# The SQL answer computes each rule on its own, run by run.
_RULE_CONTEXT = """
SELECT r.* EXCLUDE (user_id), c.* EXCLUDE (subscription_id, currency, direct_only, name, created_at),
  upper(coalesce(threshold_currency, c.currency)) AS currency,
  c.direct_only OR rule_type = 'direct_available' AS direct_only
FROM rule r JOIN context c USING (subscription_id) WHERE rule_enabled AND c.enabled"""
_RULE_PRICE = """
SELECT c.rule_id, o.run_id, o.observed_at, min(o.total_price_minor) AS price_minor,
  arg_min(o.is_direct, (o.total_price_minor, o.obs_id)) AS is_direct
FROM rule_context c JOIN obs o ON o.query_id = c.query_id AND o.currency = c.currency
JOIN feature f ON f.itinerary_id = o.itinerary_id
WHERE (NOT c.direct_only OR f.is_direct)
  AND (c.max_price_minor IS NULL OR o.total_price_minor <= c.max_price_minor)
  AND (c.max_stops IS NULL OR f.stop_count <= c.max_stops)
  AND (c.max_duration_minutes IS NULL OR f.total_duration_minutes <= c.max_duration_minutes)
  AND (len(c.airline_codes) = 0 OR list_has_any(f.airlines, c.airline_codes))
  AND (len(c.departure_airports) = 0 OR list_contains(c.departure_airports, f.first_origin))
  AND (c.departure_minute_start IS NULL OR c.departure_minute_end IS NULL
       OR (f.first_minute >= c.departure_minute_start AND f.first_minute < c.departure_minute_end))
  AND (len(c.arrival_airports) = 0 OR list_contains(c.arrival_airports, f.last_destination))
GROUP BY 1, 2, 3"""
_PREVIOUS = """
SELECT p.*, (SELECT min(e.price_minor) FROM rule_price e WHERE e.rule_id = p.rule_id AND e.observed_at < p.observed_at
  AND (c.comparison_window_days IS NULL OR e.observed_at >= p.observed_at - to_days(c.comparison_window_days::INT)))
  AS previous_minimum
FROM rule_price p JOIN rule_context c USING (rule_id)"""
_EVALUATED = """
SELECT p.*, c.rule_type, c.user_id, c.subscription_id, c.cooldown_seconds, coalesce(CASE rule_type
  WHEN 'price_threshold' THEN price_minor <= threshold_price_minor
  WHEN 'new_low' THEN previous_minimum IS NULL OR price_minor < previous_minimum
  WHEN 'percentage_drop' THEN price_minor < previous_minimum
    AND trunc((previous_minimum - price_minor) * 10000 / previous_minimum) >= threshold_percentage
  WHEN 'absolute_drop' THEN previous_minimum - price_minor >= threshold_price_minor
  WHEN 'direct_available' THEN is_direct AND (threshold_price_minor IS NULL OR price_minor <= threshold_price_minor)
  WHEN 'round_trip_range' THEN (config_min_price < 0 OR price_minor >= config_min_price)
    AND (config_max_price IS NULL OR price_minor <= config_max_price)
  ELSE false END, false) AS triggered
FROM previous p JOIN rule_context c USING (rule_id) JOIN run ON run.run_id = p.run_id
WHERE alerts_evaluated_at IS NULL"""
_PARTS = {"rule_context": _RULE_CONTEXT, "rule_price": _RULE_PRICE, "previous": _PREVIOUS, "evaluated": _EVALUATED}
# Every fourth pair of a rule and a run has been told before.
_TOLD = "(rule_id + run_id) % 4 = 0"
_EVENTS = f"""
SELECT e.*, rule_id || ':' || run_id || ':' || rule_type AS deduplication_key FROM evaluated e
LEFT JOIN (SELECT rule_id, max(created_at) AS last_at FROM alert_event WHERE created_at <= {AS_OF} GROUP BY 1) h USING (rule_id)
WHERE triggered AND (last_at IS NULL OR last_at < {AS_OF} - to_seconds(cooldown_seconds))
QUALIFY cooldown_seconds = 0 OR row_number() OVER (PARTITION BY rule_id ORDER BY observed_at, run_id) = 1"""
_EVENTS = f"SELECT * FROM ({_EVENTS}) WHERE NOT {_TOLD}"


def history(t, asked=None):
    """Rules with their wishes, and the priced run history of their branches; with ``asked`` runs,
    only of queries that have one, and answered for those runs."""
    rules = al.rule_contexts(t.alert_rules(), contexts(t))
    observations, itineraries, segments = t.observations(), t.itineraries(), t.segments()
    if asked is not None:
        due = asked.select("query_id").distinct()
        rules = rules.join(due, "query_id", "left_semi")
        observations, itineraries, segments = (x.join(due, "query_id", "left_semi") for x in (observations, itineraries, segments))
    # Rules are counted here: a subscription may have many.
    branches = al.rule_branches(rules)
    features = fl.itinerary_features(itineraries, segments)
    best = al.best_offers(observations, features, branches, small=fits_broadcast(branches))
    return rules, al.previous_minimum(best, al.rule_windows(rules), asked)


@query("alert_pending_runs", sql("SELECT run_id, finished_at FROM run WHERE status = 'succeeded' AND NOT evaluated"))
def alert_pending_runs(t):
    return al.pending_runs(t.runs()).select("run_id", "finished_at")


@query("alert_pending_batch", sql("""
SELECT run_id, finished_at FROM run WHERE status = 'succeeded' AND NOT evaluated ORDER BY finished_at, run_id LIMIT 200"""))
def alert_pending_batch(t):
    return al.pending_runs(t.runs(), 200).select("run_id", "finished_at")


@query("alert_previous_minimum", sql("""
SELECT rule_id, run_id, price_minor, is_direct, previous_minimum FROM previous""",
    rule_context=_RULE_CONTEXT, rule_price=_RULE_PRICE, previous=_PREVIOUS))
def alert_previous_minimum(t):
    rules, rows = history(t)
    keyed = rules.select("rule_id", F.col("branch_key").alias("b"), F.col("comparison_window_days").alias("d"))
    return keyed.join(rows, (F.col("b") == F.col("branch_key")) & F.col("d").eqNullSafe(F.col("window_days"))).select(
        "rule_id", "run_id", "price_minor", "is_direct", "previous_minimum")


def evaluated(t):
    rules, rows = history(t, al.pending_runs(t.runs()))
    return al.evaluate_alerts(rules, rows, t.runs())


@query("alert_evaluation", sql("""
SELECT rule_id, run_id, rule_type, price_minor, previous_minimum, triggered FROM evaluated""", **_PARTS))
def alert_evaluation(t):
    return evaluated(t).select("rule_id", "run_id", "rule_type", "price_minor", "previous_minimum", "triggered")


for _type in al.RULE_TYPES:
    query(f"alert_{_type}", sql(f"""
SELECT rule_id, run_id, price_minor, previous_minimum FROM evaluated WHERE rule_type = '{_type}' AND triggered""",
        **_PARTS))(
        lambda t, kind=_type: evaluated(t).where((F.col("rule_type") == kind) & F.col("triggered")).select(
            "rule_id", "run_id", "price_minor", "previous_minimum"))


def told_keys(t, answers):
    """Keys of the stored events: of past failures, and of a quarter of what the rules find."""
    kinds = t.alert_rules().select("rule_id", "rule_type")
    past = t.alert_events().join(kinds, "rule_id")
    found = answers.where(_TOLD).select("rule_id", "run_id", "rule_type")
    return past.select("rule_id", "run_id", "rule_type").unionByName(found).select(al.event_key().alias("deduplication_key"))


def events(t):
    """The rules are evaluated once; what they find is read as events and as a part of the stored keys."""
    stored = t.alert_events().where(F.col("created_at") <= F.lit(NOW).cast("timestamp_ntz"))
    answers = cut_lineage(evaluated(t).select(
        "rule_id", "run_id", "rule_type", "observed_at", "price_minor", "cooldown_seconds", "triggered"), codec="zstd")
    fired = al.apply_cooldown(answers.where("triggered"), stored, NOW)
    return al.dedupe_events(fired, told_keys(t, answers))


@query("alert_events", sql("""
SELECT deduplication_key, rule_id, run_id, rule_type, price_minor FROM event_rows""", **_PARTS, event_rows=_EVENTS))
def alert_events(t):
    return events(t).select("deduplication_key", "rule_id", "run_id", "rule_type", "price_minor")


_TARGETS = """
SELECT rule_id, channel_id FROM (
  SELECT r.rule_id, c.channel_id, l.channel_id IS NOT NULL AS linked,
    bool_or(l.channel_id IS NOT NULL) OVER (PARTITION BY r.rule_id) AS any_linked
  FROM rule r JOIN channel c ON c.user_id = r.user_id AND c.enabled
  LEFT JOIN rule_channel l ON l.rule_id = r.rule_id AND l.channel_id = c.channel_id)
WHERE linked = any_linked"""


@query("rule_targets", sql("SELECT * FROM targets", targets=_TARGETS))
def rule_targets(t):
    return al.rule_targets(t.alert_rules(), t.rule_channels(), t.channels())


@query("alert_deliveries", sql(f"""
SELECT deduplication_key, channel_id, 'pending' AS status, {AS_OF} AS next_attempt_at
FROM event_rows JOIN targets USING (rule_id)""", **_PARTS, event_rows=_EVENTS, targets=_TARGETS))
def alert_deliveries(t):
    targets = al.rule_targets(t.alert_rules(), t.rule_channels(), t.channels())
    return al.fan_out_deliveries(events(t), targets, NOW).select(
        "deduplication_key", "channel_id", "status", "next_attempt_at")


@query("deliverable", sql(f"""
SELECT delivery_id, status, next_attempt_at FROM delivery JOIN channel USING (channel_id)
WHERE enabled AND ((status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= {AS_OF}))
  OR (status = 'failed' AND next_attempt_at <= {AS_OF})
  OR (status = 'sending' AND updated_at <= {AS_OF} - INTERVAL 900 SECOND))"""))
def deliverable(t):
    return de.deliverable(t.deliveries(), t.channels(), NOW).select("delivery_id", "status", "next_attempt_at")


@query("delivery_retry", sql("""
SELECT delivery_id, CASE WHEN attempt_count < 5 THEN updated_at +
  to_seconds(least(30000 * 2 ** greatest(attempt_count - 1, 0), 86400)::BIGINT) END AS retry_at
FROM delivery WHERE status = 'failed'"""))
def delivery_retry(t):
    return t.deliveries().where("status = 'failed'").select(
        "delivery_id", de.retry_at(F.col("updated_at"), F.col("attempt_count"), 30000, 5).alias("retry_at"))


_HOURS = "CASE timezone WHEN 'Asia/Shanghai' THEN 8 WHEN 'Asia/Tokyo' THEN 9 ELSE 0 END"


@query("next_delivery_at", sql(f"""
SELECT delivery_id, CASE WHEN slot_free OR open_now THEN updated_at ELSE (
    SELECT min(c) FROM (SELECT day0 + to_days(d) + to_minutes(m) - to_hours(h) AS c, day0 + to_days(d) + to_minutes(m) AS l
      FROM range(15) g(d), (VALUES (0), (480)) v(m))
    WHERE c >= updated_at AND hour(l) * 60 + minute(l) >= 480 AND hour(l) * 60 + minute(l) < 1320
      AND (NOT weekdays_only OR isodow(l) <= 5)) END AS next_at
FROM (SELECT delivery_id, updated_at, h, date_trunc('day', here)::TIMESTAMP AS day0, weekdays_only,
    quiet_start_minute IS NULL AND NOT weekdays_only AS slot_free,
    hour(here) * 60 + minute(here) >= 480 AND hour(here) * 60 + minute(here) < 1320
      AND (NOT weekdays_only OR isodow(here) <= 5) AS open_now
  FROM (SELECT *, {_HOURS} AS h, updated_at + to_hours({_HOURS}) AS here FROM delivery JOIN channel USING (channel_id)))"""))
def next_delivery_at(t):
    rows = t.deliveries().join(t.channels().drop("user_id", "enabled"), "channel_id")
    return rows.select("delivery_id", de.next_delivery_at(
        F.col("updated_at"), F.col("timezone"), F.col("quiet_start_minute"), F.col("quiet_end_minute"),
        F.col("allowed_weekdays")).alias("next_at"))


@query("target_prices", sql("""
SELECT subscription_id, threshold_price_minor AS target_price_minor, threshold_currency AS target_currency FROM rule
WHERE rule_type = 'price_threshold' AND threshold_price_minor IS NOT NULL AND config_source = 'subscription_target_price'"""))
def target_prices(t):
    return al.target_prices(t.alert_rules())


@query("event_list", sql("""
SELECT event_id, rule_id, subscription_id, rule_type, created_at FROM alert_event JOIN rule USING (rule_id)"""))
def event_list(t):
    return al.event_list(t.alert_events(), t.alert_rules()).select(
        "event_id", "rule_id", "subscription_id", "rule_type", "created_at")


@query("recent_deliveries", sql("""
SELECT user_id, delivery_id, updated_at, page_row FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, delivery_id DESC) AS page_row
  FROM delivery JOIN channel USING (channel_id)) WHERE page_row <= 200"""))
def recent_deliveries(t):
    owned = t.deliveries().join(t.channels().select("channel_id", "user_id"), "channel_id")
    return first_pages(owned, ["user_id"], ["updated_at", "delivery_id"], 200, descending=True).select(
        "user_id", "delivery_id", "updated_at", "page_row")


