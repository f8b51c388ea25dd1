"""Runs: health, counters, pages, diagnostics, shapes, planning."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from catalog.duck import AS_OF, sql
from catalog.registry import query
from skyledger.functions import payload as pl
from skyledger.functions import times as tm
from skyledger.operators import filters as fl
from skyledger.operators import runs as ru
from skyledger.operators import writes as wr
from skyledger.operators.paging import first_pages, page_ends
from skyledger.session import cut_lineage
from skyledger.skew import fits_broadcast, join_checked
from skyledger.sources.testdata import AS_OF as NOW

_VISIBLE = """SELECT DISTINCT s.user_id, r.* FROM run r JOIN sub s ON s.query_id = r.query_id {where}
UNION SELECT on_demand_user AS user_id, r.* FROM run r WHERE on_demand_user IS NOT NULL"""


@query("visible_runs", sql("SELECT user_id, run_id FROM visible", visible=_VISIBLE.format(where="")))
def visible_runs(t):
    return fl.visible_runs(t.runs(), t.subscriptions()).select("user_id", "run_id")


_HEALTH = f"""
SELECT u.user_id, last_success_at, CASE WHEN terminal > 0 THEN good::DOUBLE / terminal::DOUBLE * 100.0 END AS success_rate_24h,
  next_scheduled_at
FROM (SELECT user_id, min(next_due_at) FILTER (enabled) AS next_scheduled_at FROM sub GROUP BY 1) u
LEFT JOIN (SELECT user_id, max(finished_at) FILTER (status = 'succeeded' AND finished_at <= {AS_OF}) AS last_success_at,
    count(*) FILTER (recent AND status = 'succeeded') AS good, count(*) FILTER (recent) AS terminal
  FROM (SELECT *, coalesce(status IN ('succeeded','failed','canceled')
         AND finished_at BETWEEN {AS_OF} - INTERVAL 24 HOUR AND {AS_OF}, false) AS recent FROM visible)
  GROUP BY 1) h USING (user_id)"""


@query("collection_health", sql(_HEALTH, visible=_VISIBLE.format(where="AND s.enabled")))
def collection_health(t):
    return ru.collection_health(t.runs(), t.subscriptions(), NOW)


@query("run_status_counts", sql(f"""
SELECT user_id, count(*) FILTER (status = 'pending' AND scheduled_at <= {AS_OF}) AS ready,
  count(*) FILTER (status = 'pending' AND scheduled_at > {AS_OF}) AS retrying,
  count(*) FILTER (status = 'leased') AS leased, count(*) FILTER (status = 'running') AS running,
  count(*) FILTER (status = 'failed' AND finished_at >= {AS_OF} - INTERVAL 24 HOUR) AS failed_24h
FROM visible GROUP BY 1""", visible=_VISIBLE.format(where="")))
def run_status_counts(t):
    return ru.run_status_counts(t.runs(), t.subscriptions(), NOW)


@query("subscription_counts", sql("""
SELECT user_id, count(*) FILTER (enabled) AS active_subscriptions, count(DISTINCT query_id) AS routes_tracked
FROM sub GROUP BY 1"""))
def subscription_counts(t):
    return ru.subscription_counts(t.subscriptions())


@query("duration_percentiles", sql("""
SELECT min(ms) AS min, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99,
  max(ms) AS max FROM (SELECT date_diff('millisecond', started_at, finished_at) AS ms FROM run) WHERE ms IS NOT NULL"""))
def duration_percentiles(t):
    timed = t.runs().select(fl.run_duration_ms(F.col("started_at"), F.col("finished_at")).alias("ms"))
    return ru.duration_percentiles(timed, "ms")


_PAGE = """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scheduled_at DESC, run_id DESC) AS page_row,
  count(*) OVER (PARTITION BY user_id) > 20 AS has_more FROM visible"""


@query("run_second_page", sql("""
SELECT user_id, run_id, scheduled_at, page_row - 20 AS page_row, total > 40 AS has_more
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM page) WHERE page_row BETWEEN 21 AND 40""",
    visible=_VISIBLE.format(where=""), page=_PAGE))
def run_second_page(t):
    first = ru.run_pages(t.runs(), t.subscriptions(), 20)
    ends = page_ends(first, ["user_id"], ru.RUN_ORDER, descending=True)
    pages = ru.run_pages(t.runs(), t.subscriptions(), 20, ends)
    return pages.select("user_id", "run_id", "scheduled_at", "page_row", "has_more")


def issues(t):
    return t.raw("lineitem").selectExpr(
        "l_orderkey AS run_id", "CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'parse' END AS source",
        "struct(l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq",
        "CASE WHEN l_linenumber <> 5 THEN concat('code_', l_linenumber % 4) END AS code",
        "'decode' AS kind", "CASE WHEN l_linenumber % 2 = 0 THEN concat('text ', l_linenumber % 3) END AS message",
        "CASE WHEN l_suppkey % 2 = 0 THEN '$.data' END AS path",
        "CASE WHEN l_linestatus = 'O' THEN 'error' ELSE 'warning' END AS severity",
        "CASE WHEN l_linenumber % 3 > 0 THEN concat('list', repeat('x', 30 * l_linenumber)) END AS observed_type",
        "CASE WHEN l_partkey % 3 = 0 THEN 'True' WHEN l_partkey % 3 = 1 THEN 'false' END AS retryable",
    )


_DIAGNOSTICS = """
SELECT run_id, code, message, path, severity, observed_type, retryable, from_last FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY late DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
      l_quantity DESC) AS from_last
  FROM (SELECT l_orderkey AS run_id, coalesce('code_' || nullif(l_linenumber, 5) % 4, 'decode') AS code,
      coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'text ' || (l_linenumber % 3) END,
               coalesce('code_' || nullif(l_linenumber, 5) % 4, 'decode')) AS message,
      CASE WHEN l_suppkey % 2 = 0 THEN '$.data' END AS path, l_returnflag = 'R' AS late,
      CASE WHEN l_linestatus = 'O' OR l_returnflag = 'R' THEN 'error' ELSE 'warning' END AS severity,
      CASE WHEN l_partkey % 3 = 0 THEN true WHEN l_partkey % 3 = 1 THEN false END AS retryable,
      CASE WHEN l_linenumber % 3 > 0 THEN substr('list' || repeat('x', 30 * l_linenumber), 1, 120) END AS observed_type,
      l_linenumber, l_partkey, l_suppkey, l_quantity
    FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY run_id, code, message, path
      ORDER BY late DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1))
WHERE from_last <= 20"""


@query("run_diagnostics", sql(_DIAGNOSTICS))
def run_diagnostics(t):
    return ru.run_diagnostics(issues(t)).withColumn("from_last", F.col("from_last").cast("bigint"))


@query("run_list_view", sql("""
SELECT user_id, run_id, page_row, has_more,
  provider || ' · ' || trip_type || ' · ' || substr(query_hash, 1, 8) AS query_label, provider,
  CASE status WHEN 'succeeded' THEN 'success' WHEN 'failed' THEN 'failed' WHEN 'canceled' THEN 'blocked'
    ELSE 'running' END AS status,
  coalesce(started_at, scheduled_at) AS started_at, finished_at, attempt,
  date_diff('millisecond', started_at, finished_at) AS duration_ms,
  CASE WHEN upstream_status = 'success_with_warnings' AND partial_data THEN 'partial_fare_data' END AS warning_code,
  error_code, max_attempts, upstream_status, schema_fingerprint, coalesce(c, 0) AS calendar_count,
  coalesce(i, 0) AS itinerary_count, coalesce(i, 0) AS offer_count, diagnostics, last_success_at, success_rate_24h,
  next_scheduled_at
FROM page JOIN query USING (query_id) JOIN health USING (user_id)
LEFT JOIN (SELECT run_id, count(*) AS c FROM calobs GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS i FROM offer GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT run_id, string_agg(code || ':' || severity, ',' ORDER BY from_last DESC) AS diagnostics
  FROM diagnostic GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT event_id // 5 AS run_id, min('shape' || event_type) AS schema_fingerprint FROM event GROUP BY 1) USING (run_id)
WHERE page_row <= 20""", visible=_VISIBLE.format(where=""), page=_PAGE, diagnostic=_DIAGNOSTICS,
    visible_enabled=_VISIBLE.format(where="AND s.enabled"), health=_HEALTH.replace("visible)", "visible_enabled)")))
def run_list_view(t):
    """Counts, diagnostics and the header are joined to the pages only, which are written once."""
    pages = cut_lineage(ru.run_pages(t.runs(), t.subscriptions(), 20))
    listed = pages.select("run_id").distinct()
    few = fits_broadcast(listed)

    def of_pages(rows):
        return join_checked(rows, listed, ["run_id"], "left_semi", small=few)

    counts = wr.run_summary_counts(
        of_pages(t.runs()), of_pages(t.calendar_observations()), of_pages(t.itineraries()), of_pages(t.offers()))
    shapes = t.events().selectExpr("event_id div 5 AS run_id", "event_type").groupBy("run_id").agg(
        F.min(F.concat(F.lit("shape"), "event_type")).alias("schema_fingerprint"))
    return ru.run_list_view(
        pages, t.queries(), counts, of_pages(shapes), ru.run_diagnostics(of_pages(issues(t))),
        ru.collection_health(t.runs(), t.subscriptions(), NOW))


# Captured payloads, one per event, in five forms; one of them is no JSON.
CAPTURED = (
    "event_id", "observed_at", "'alpha' AS provider", "concat('/search/', query_id % 3) AS endpoint",
    """CASE event_type
         WHEN 'click' THEN concat('{"status":0,"data":', props, '}')
         WHEN 'view' THEN concat('{"status":"ok","data":{"items":[', props, ',{"k":null}]}}')
         WHEN 'purchase' THEN '{"flag":true,"data":{"items":[]}}'
         WHEN 'signup' THEN props ELSE concat('no json ', props) END AS payload""",
)


def captured_shapes(t):
    return t.events().selectExpr(*CAPTURED)


_SHAPE_OF = """array_to_string(CASE event_type
  WHEN 'click' THEN ['number /data/k', 'number /status', 'object ', 'object /data']
  WHEN 'view' THEN ['list /data/items', 'null /data/items/[]/k', 'number /data/items/[]/k', 'object ', 'object /data',
    'object /data/items/[]', 'string /status']
  WHEN 'purchase' THEN ['boolean /flag', 'list /data/items', 'object ', 'object /data']
  WHEN 'signup' THEN ['number /k', 'object '] END, chr(10))"""
_SHAPES = f"""SELECT 'alpha' AS provider, '/search/' || (query_id % 3) AS endpoint, sha256({_SHAPE_OF}) AS shape_fingerprint,
  min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, count(*) AS occurrence_count
  FROM event WHERE event_type <> 'error' GROUP BY ALL"""


def shapes(t):
    rows = captured_shapes(t).withColumn("shape_fingerprint", pl.shape_fingerprint(F.col("payload")))
    return wr.upsert_shapes(None, rows.where("shape_fingerprint IS NOT NULL"))


@query("payload_shapes", sql(_SHAPES))
def payload_shapes(t):
    return shapes(t)


@query("payload_shape_fields", sql(f"""
SELECT event_id, CASE event_type WHEN 'click' THEN 'data,status' WHEN 'view' THEN 'data,status'
  WHEN 'purchase' THEN 'data,flag' ELSE 'k' END AS fields,
  CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 36 WHEN 'purchase' THEN 2 ELSE 1 END::BIGINT AS richness
FROM event WHERE event_type <> 'error'"""))
def payload_shape_fields(t):
    rows = captured_shapes(t).select(
        "event_id", pl.payload_shape("payload").alias("shape"), pl.payload_richness("payload").alias("richness"))
    return rows.where("shape IS NOT NULL").select(
        "event_id", F.array_join(pl.top_level_fields(F.col("shape")), ",").alias("fields"), "richness")


@query("shape_signals", sql("""
SELECT *, CASE WHEN rank > 1 THEN 'historical' WHEN first_seen_at >= TIMESTAMP '2024-01-01 12:00:00' THEN 'new'
  ELSE 'current' END AS state FROM (
  SELECT *, row_number() OVER (PARTITION BY provider, endpoint ORDER BY last_seen_at DESC, shape_fingerprint DESC) AS rank
  FROM shape)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (rank), CASE", 1), shape=_SHAPES))
def shape_signals(t):
    from datetime import datetime

    return ru.shape_signals(shapes(t), datetime(2024, 1, 2, 12))


def providers(t):
    return t.spark.createDataFrame([("alpha", True), ("beta", False)], "code string, enabled boolean")


@query("due_by_query", sql(f"""
SELECT q.query_id, provider, count(*) AS subscription_count, min(next_due_at) AS oldest_due_at,
  'scheduled:' || q.query_id || ':' || floor(epoch({AS_OF}) / 900)::BIGINT AS idempotency_key
FROM sub JOIN query q USING (query_id)
WHERE enabled AND next_due_at <= {AS_OF} AND provider = 'alpha' AND NOT EXISTS (
  SELECT 1 FROM run r WHERE r.query_id = q.query_id AND status IN ('pending','leased','running'))
GROUP BY ALL"""))
def due_by_query(t):
    return ru.due_by_query(t.subscriptions(), t.queries(), providers(t), t.runs(), NOW)


@query("advance_due", sql(f"""
SELECT subscription_id, next_due_at + to_seconds(poll_interval_seconds *
  (date_diff('second', next_due_at, {AS_OF}) // poll_interval_seconds + 1)) AS next_due_at
FROM sub WHERE enabled AND next_due_at <= {AS_OF}"""))
def advance_due(t):
    return ru.advanced_due(t.subscriptions(), NOW).select("subscription_id", "next_due_at")


@query("pending_runs", sql(f"""
SELECT run_id, scheduled_at FROM run
WHERE status = 'pending' AND scheduled_at <= {AS_OF} AND attempt < max_attempts"""))
def pending_runs(t):
    return ru.pending_runs(t.runs(), NOW).select("run_id", "scheduled_at")


@query("pending_batch", sql(f"""
SELECT run_id, scheduled_at FROM run
WHERE status = 'pending' AND scheduled_at <= {AS_OF} AND attempt < max_attempts ORDER BY scheduled_at, run_id LIMIT 25"""))
def pending_batch(t):
    return ru.pending_runs(t.runs(), NOW, 25).select("run_id", "scheduled_at")


@query("expired_runs", sql(f"""
SELECT run_id, query_id, status AS previous_status, CASE WHEN attempt >= 3 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN attempt >= 3 THEN scheduled_at ELSE {AS_OF} END AS scheduled_at,
  CASE WHEN attempt >= 3 THEN {AS_OF} END AS finished_at,
  CASE WHEN attempt >= 3 THEN 'lease_expired_attempts_exhausted' END AS error_code
FROM run WHERE lease_expires_at <= {AS_OF}"""))
def expired_runs(t):
    return ru.expired_runs(t.runs(), NOW)


@query("reuse_or_create_run", sql(f"""
SELECT q.query_id, coalesce(a.run_id, s.run_id) AS run_id,
  CASE WHEN a.run_id IS NOT NULL THEN 'active' WHEN s.run_id IS NOT NULL THEN 'recent' ELSE 'new' END AS source,
  CASE WHEN a.run_id IS NULL AND s.run_id IS NULL THEN 'on-demand:' || query_hash || ':' ||
    floor(epoch({AS_OF}) / 86400)::BIGINT || ':' || coalesce(n, 0) END AS idempotency_key
FROM query q
LEFT JOIN (SELECT query_id, arg_max(run_id, (scheduled_at, run_id)) AS run_id FROM run
  WHERE status IN ('pending','leased','running') GROUP BY 1) a USING (query_id)
LEFT JOIN (SELECT query_id, arg_max(run_id, (finished_at, run_id)) AS run_id FROM run
  WHERE status = 'succeeded' AND scheduled_at >= TIMESTAMP '1998-06-30' GROUP BY 1) s USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM run
  WHERE status IN ('failed','canceled') AND scheduled_at >= TIMESTAMP '1998-06-30' GROUP BY 1) f USING (query_id)"""))
def reuse_or_create_run(t):
    return ru.reuse_or_create(t.queries(), t.runs(), NOW, 86400)


@query("retry_schedule", sql("""
SELECT run_id, attempt, CASE WHEN attempt < 3 THEN least(30 * 2 ** (attempt - 1), 50)::BIGINT END AS delay_seconds,
  CASE WHEN attempt < 3 THEN finished_at + to_seconds(least(30 * 2 ** (attempt - 1), 50)::BIGINT) END AS retry_at
FROM run WHERE status = 'failed'"""))
def retry_schedule(t):
    return ru.retry_schedule(t.runs(), 30, 50)


@query("retry_schedule_jitter", sql("""
SELECT run_id, attempt, CASE WHEN attempt < 3 THEN delay END AS delay_seconds,
  CASE WHEN attempt < 3 THEN finished_at + to_seconds(delay) END AS retry_at
FROM (SELECT *, ceil(least(50.0, least(30 * 2 ** (attempt - 1), 50) * (1 + (run_id % 97) / 97)))::BIGINT AS delay
  FROM run WHERE status = 'failed')"""))
def retry_schedule_jitter(t):
    return ru.retry_schedule(t.runs(), 30, 50, (F.col("run_id") % 97) / 97)


@query("bucket_key", sql("""
SELECT run_id, 'scheduled:' || query_id || ':' || (floor(epoch(scheduled_at) / 900)::BIGINT) AS idempotency_key FROM run"""))
def bucket_key(t):
    return t.runs().select("run_id", F.concat_ws(
        ":", F.lit("scheduled"), F.col("query_id").cast("string"),
        tm.bucket_index(F.col("scheduled_at"), 900).cast("string")).alias("idempotency_key"))


@query("quota_usage", sql("""
SELECT user_id, count(*) FILTER (status IN ('pending','running')) AS active_jobs,
  count(*) FILTER (status IN ('succeeded','expired') AND file_name IS NOT NULL) AS kept_files,
  coalesce(sum(size_bytes) FILTER (status IN ('succeeded','expired') AND file_name IS NOT NULL), 0)::BIGINT AS kept_bytes
FROM export_job GROUP BY 1"""))
def quota_usage(t):
    return ru.quota_usage(t.export_jobs())


def _page_oracle(table: str, row_id: str, stamp: str, limit: int, page: int = 1) -> str:
    skipped = (page - 1) * limit
    return sql(f"""
SELECT user_id, {row_id}, {stamp}, page_row - {skipped} AS page_row, has_more FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {stamp} DESC, {row_id} DESC) AS page_row,
    count(*) OVER (PARTITION BY user_id) > {skipped + limit} AS has_more FROM {table} WHERE {stamp} <= {AS_OF})
WHERE page_row BETWEEN {skipped + 1} AND {skipped + limit}""")


def _newest_page(rows, row_id: str, stamp: str, limit: int):
    seen = rows.where(F.col(stamp) <= F.lit(NOW).cast("timestamp_ntz"))
    return first_pages(seen, ["user_id"], [stamp, row_id], limit, descending=True).select(
        "user_id", row_id, stamp, "page_row", "has_more")


@query("subscription_page", _page_oracle("sub", "subscription_id", "created_at", 20))
def subscription_page(t):
    return _newest_page(t.subscriptions(), "subscription_id", "created_at", 20)


@query("subscription_second_page", _page_oracle("sub", "subscription_id", "created_at", 20, 2))
def subscription_second_page(t):
    rows, keys = t.subscriptions().where(F.col("created_at") <= F.lit(NOW).cast("timestamp_ntz")), ["created_at", "subscription_id"]
    first = first_pages(rows, ["user_id"], keys, 20, descending=True)
    ends = page_ends(first, ["user_id"], keys, descending=True)
    return first_pages(rows, ["user_id"], keys, 20, descending=True, cursors=ends).select(
        "user_id", "subscription_id", "created_at", "page_row", "has_more")


@query("event_page", _page_oracle("alert_event", "event_id", "created_at", 50))
def event_page(t):
    return _newest_page(t.alert_events(), "event_id", "created_at", 50)


@query("export_page", _page_oracle("export_job", "job_id", "created_at", 20))
def export_page(t):
    return _newest_page(t.export_jobs(), "job_id", "created_at", 20)


@query("run_outcome", sql("""
SELECT run_id, CASE WHEN cal = 0 AND seen = 0 THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN cal = 0 AND seen = 0 THEN 'no_persistable_data' END AS error_code,
  CASE WHEN cal = 0 AND seen = 0 THEN 'schema_missing' WHEN seen = 0 OR miss > 0 OR notes > 0 THEN 'success_with_warnings'
    ELSE 'success' END AS upstream_status,
  (cal > 0 OR seen > 0) AND (seen = 0 OR miss > 0) AS partial_data
FROM (SELECT o_orderkey AS run_id, coalesce(n, 0) AS cal, coalesce(d, 0) AS seen, o_orderkey % 5 // 4 AS miss,
        o_orderkey % 3 // 2 AS notes
  FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 3 = 0) AS d
    FROM lineitem GROUP BY 1) USING (o_orderkey))"""))
def run_outcome(t):
    counts = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linenumber") % 3 == 0).alias("d"))
    rows = t.raw("orders").select(F.col("o_orderkey").alias("run_id")).join(counts, "run_id", "left")
    rows = rows.selectExpr("run_id", "coalesce(n, 0) AS calendar_count", "coalesce(d, 0) AS observation_count",
                           "run_id % 5 div 4 AS missing_captures", "run_id % 3 div 2 AS diagnostic_count")
    return ru.run_outcome(rows).select("run_id", "status", "error_code", "upstream_status", "partial_data")


@query("run_summary_counts", sql("""
SELECT run_id, coalesce(c, 0) AS calendar_count, coalesce(i, 0) AS itinerary_count, coalesce(i, 0) AS offer_count,
  coalesce(i, 0) AS observation_count
FROM run LEFT JOIN (SELECT run_id, count(*) AS c FROM calobs GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS i FROM offer GROUP BY 1) USING (run_id)"""))
def run_summary_counts(t):
    return wr.run_summary_counts(
        t.runs(), t.calendar_observations(), t.itineraries(), t.offers(), t.observations())


@query("advance_subscriptions", sql(f"""
SELECT subscription_id, last_collected_at, CASE WHEN enabled AND last_collected_at IS NOT NULL
  THEN last_collected_at + to_seconds(poll_interval_seconds) ELSE next_due_at END AS next_due_at
FROM sub LEFT JOIN (SELECT query_id, max(finished_at) AS last_collected_at FROM run
  WHERE status = 'succeeded' GROUP BY 1) USING (query_id)"""))
def advance_subscriptions(t):
    done = t.runs().where("status = 'succeeded'").withColumnRenamed("finished_at", "observed_at")
    return wr.advance_subscriptions(t.subscriptions(), done).select(
        "subscription_id", "last_collected_at", "next_due_at")


@query("decouple_target_price", sql("""
SELECT f.subscription_id, CASE WHEN EXISTS (SELECT 1 FROM rule r WHERE r.subscription_id = f.subscription_id
  AND rule_type = 'price_threshold' AND config_source = 'subscription_target_price'
  AND threshold_price_minor = f.max_price_minor) THEN NULL ELSE f.max_price_minor END AS max_price_minor
FROM (SELECT c_custkey AS subscription_id, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal * 100)::BIGINT * 4
      ELSE 4000000 END AS max_price_minor FROM customer) f"""))
def decouple_target_price(t):
    filters = t.raw("customer").selectExpr(
        "c_custkey AS subscription_id",
        "CASE WHEN c_custkey % 2 = 0 THEN cast(round(c_acctbal * 100) AS bigint) * 4 ELSE 4000000L END AS max_price_minor")
    return wr.decouple_target_price(filters, t.alert_rules())


@query("unique_slugs", sql("""
SELECT s_suppkey, CASE WHEN s_suppkey = min(s_suppkey) OVER (PARTITION BY base) THEN base
  ELSE base || '-' || substr(sha256(s_suppkey::VARCHAR), 1, 16) END AS slug
FROM (SELECT s_suppkey, 'supplier-' || (s_nationkey % 7) AS base FROM supplier)"""))
def unique_slugs(t):
    mails = t.raw("supplier").selectExpr(
        "s_suppkey", "concat(' Supplier #', s_nationkey % 7, '@Example.org') AS email")
    return wr.unique_slugs(mails, "email", "s_suppkey").select("s_suppkey", "slug")
