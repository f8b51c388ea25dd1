"""Streaming jobs over the events and fare tables, run until all input is read."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog import normalize as cn
from catalog import runs as cr
from catalog.duck import sql
from catalog.registry import query
from skyledger.operators import normalize as no
from skyledger.session import work_dir
from skyledger.sources import observations as ob
from skyledger.streaming import jobs

_OBS = """SELECT query_id, 'CNY' AS currency, event_type IN ('click','view') AS is_direct, observed_at,
  event_id // 5 AS run_id, price_minor AS total_price_minor, event_id FROM event"""


def events(t, raw=None):
    """The events file, or files with its rows, as a stream."""
    if raw is None:
        raw = jobs.stream_files(t.spark, t.folder, t.raw("events").schema, "events.parquet")
    return raw.selectExpr(
        "event_id", "ts AS observed_at", "user_id AS query_id", "event_type",
        "cast(round(value * 100) AS bigint) AS price_minor", "props")


def landed(t, shape, fifths_per_batch: int = 2):
    """The events as a stream of five fifths, the newest first, each in as many files as it has partitions."""
    folder = f"{work_dir(t.spark, 'landed')}/events"
    rows = t.raw("events")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    step = (high - low) // 5 + 1
    # Runs of five events are cut by some of the bounds.
    for k in range(4, -1, -1):
        part = rows.where(F.col("event_id").between(low + k * step, low + (k + 1) * step - 1))
        part.write.mode("append").parquet(folder)
    files = -(-len(t.spark.read.parquet(folder).inputFiles()) * fifths_per_batch // 5)
    return shape(t, jobs.stream_files(t.spark, folder, rows.schema, "*.parquet", files))


def observations(t, raw=None):
    return events(t, raw).selectExpr(
        "query_id", "'CNY' AS currency", "event_type IN ('click', 'view') AS is_direct", "observed_at",
        "event_id div 5 AS run_id", "price_minor AS total_price_minor", "lpad(event_id, 12, '0') AS offer_fingerprint",
        "cast(event_id AS string) AS itinerary_id", "cast(event_id AS string) AS offer_id")


def place(t, name: str) -> tuple[str, str]:
    base = work_dir(t.spark, name)
    return f"{base}/out", f"{base}/checkpoint"


@query("stream_latest_snapshot", sql("""
SELECT query_id, currency, is_direct, observed_at, run_id, total_price_minor FROM o
QUALIFY row_number() OVER (PARTITION BY query_id, currency, is_direct
  ORDER BY observed_at DESC, run_id DESC, total_price_minor, event_id) = 1""", o=_OBS))
def stream_latest_snapshot(t):
    out, checkpoint = place(t, "snapshot")
    jobs.latest_snapshots(landed(t, observations), out, checkpoint)
    return jobs.read_newest(t.spark, out, jobs.snapshots_of).drop("offer_fingerprint", "itinerary_id", "offer_id")


@query("stream_daily_trend", sql("""
SELECT query_id, observed_at::DATE AS observation_date, currency, direct_only, min(price) AS lowest_price_minor,
  max(price) AS highest_price_minor, sum(price)::BIGINT AS price_sum_minor, count(*) AS sample_count,
  min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at
FROM (SELECT query_id, currency, run_id, observed_at, m.direct_only, min(total_price_minor) AS price
  FROM o JOIN (VALUES (false), (true)) m(direct_only) ON (NOT m.direct_only OR is_direct) GROUP BY ALL) GROUP BY ALL""",
    o=_OBS))
def stream_daily_trend(t):
    out, checkpoint = place(t, "daily")
    jobs.maintain_daily_trend(landed(t, observations), f"{out}/raw", f"{out}/daily", checkpoint, ["observed_at", "offer_id"])
    return jobs.read_daily(t.spark, f"{out}/daily")


@query("stream_hourly_history", sql("""
SELECT query_id, date_trunc('hour', observed_at)::TIMESTAMP AS bucket, min(total_price_minor) AS lowest_price_minor,
  max(total_price_minor) AS highest_price_minor, sum(total_price_minor)::BIGINT AS price_sum_minor, count(*) AS sample_count
FROM o GROUP BY 1, 2""", o=_OBS))
def stream_hourly_history(t):
    out, checkpoint = place(t, "hourly")
    """Five files, newest first, so that all but the first are late; read twice, in other cuts."""
    for files, name in ((2, "first"), (3, "again")):
        rows = landed(t, observations, files)
        jobs.hourly_history(rows, f"{out}/raw", f"{out}/hourly", f"{checkpoint}-{name}", ["observed_at", "offer_id"])
    return jobs.read_hourly(t.spark, f"{out}/hourly")


def state_events(t, raw=None):
    return events(t, raw).selectExpr("event_id", "observed_at", "query_id", "event_id div 5 AS run_id", "event_type AS state")


@query("stream_run_states", sql("""
SELECT user_id, event_id, e.query_id, event_type AS state, observed_at
FROM event e JOIN (SELECT DISTINCT user_id, query_id FROM sub) USING (query_id)
UNION SELECT o_custkey % 25, event_id, e.query_id, event_type, e.observed_at
FROM event e JOIN orders ON o_orderkey = event_id // 5 WHERE o_orderpriority = '1-URGENT'"""))
def stream_run_states(t):
    out, checkpoint = place(t, "states")
    jobs.visible_events(state_events(t), t.subscriptions(), out, checkpoint, t.runs())
    return t.spark.read.parquet(out).drop(*jobs.BATCH_COLUMNS)


@query("latest_run_state", sql("""
SELECT event_id // 5 AS run_id, event_type AS state, observed_at FROM event
QUALIFY row_number() OVER (PARTITION BY event_id // 5 ORDER BY observed_at DESC, event_id DESC) = 1"""))
def latest_run_state(t):
    out, checkpoint = place(t, "latest-state")
    jobs.run_states(landed(t, state_events), out, checkpoint)
    return jobs.read_newest(t.spark, out, jobs.states_of).drop("event_id")


@query("stream_shape_drift", sql("SELECT DISTINCT endpoint, shape_fingerprint FROM shape", shape=cr._SHAPES))
def stream_shape_drift(t):
    out, checkpoint = place(t, "shapes")
    captures = events(t).selectExpr(*cr.CAPTURED)
    jobs.new_shapes(captures, out, checkpoint)
    return t.spark.read.parquet(out).drop(*jobs.BATCH_COLUMNS)


@query("stream_ingest", sql("""
SELECT DISTINCT run_id, departure_date, lowest_price_minor FROM (
  SELECT run_id, l_shipdate::DATE AS departure_date, min(price) AS lowest_price_minor FROM line GROUP BY ALL)"""))
def stream_ingest(t):
    """Captured payloads are written as five files, streamed in, parsed and stored; further
    passes over the same files from empty checkpoints, in other cuts, add and lose nothing."""
    out, checkpoint = place(t, "ingest")
    cn.plain_captures(t).repartition(5, "run_id").write.parquet(f"{out}/captures")
    schema = t.spark.read.parquet(f"{out}/captures").schema

    def normalize(batch):
        rows = no.dedupe_calendar(no.parse_calendar(batch))
        return rows.groupBy("run_id", "departure_date").agg(
            F.min("lowest_price_minor").alias("lowest_price_minor")
        ).withColumn("observed_at", F.col("departure_date").cast("timestamp_ntz"))

    for files in (2, 3, 1):
        captures = jobs.stream_files(t.spark, f"{out}/captures", schema, "*.parquet", files)
        jobs.ingest(captures, f"{out}/rows", f"{checkpoint}-{files}", normalize, ["run_id", "departure_date"])
    return t.spark.read.parquet(f"{out}/rows").select("run_id", "departure_date", "lowest_price_minor")


_RULES = """SELECT c_custkey AS rule_id, c_custkey AS query_id, 'CNY' AS currency,
  ['price_threshold','new_low','absolute_drop','percentage_drop','direct_available','round_trip_range'][c_custkey % 6 + 1]
    AS rule_type, c_custkey % 7 > 0 AS enabled, 1000 + (c_custkey % 5) * 500 AS threshold_price_minor,
  500 + c_custkey % 9 * 1000 AS threshold_percentage, c_custkey % 4 * 700 - 700 AS config_min_price,
  CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 * 2000 END AS config_max_price,
  86400 * (1 + c_custkey % 3) AS cooldown_seconds FROM customer"""
_FIRED = """
WITH RECURSIVE {tables}, price AS (SELECT query_id, currency, run_id, min(observed_at) AS observed_at, min(total_price_minor) AS price,
      arg_min(is_direct, (total_price_minor, is_direct)) AS is_direct
    FROM o WHERE run_id IN (SELECT event_id // 5 FROM event WHERE event_id % 5 = 4) GROUP BY ALL),
trig AS (SELECT * FROM (SELECT r.rule_id, p.run_id, p.observed_at, p.price, r.cooldown_seconds, r.rule_type,
    r.threshold_price_minor AS limit_price, r.threshold_percentage, r.config_min_price, r.config_max_price, p.is_direct,
    min(p.price) OVER (PARTITION BY r.rule_id ORDER BY p.observed_at, p.run_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
  FROM price p JOIN r ON r.query_id = p.query_id AND r.currency = p.currency WHERE r.enabled)
  WHERE CASE rule_type WHEN 'price_threshold' THEN price <= limit_price
    WHEN 'new_low' THEN previous IS NULL OR price < previous WHEN 'absolute_drop' THEN previous - price >= limit_price
    WHEN 'percentage_drop' THEN price < previous AND (previous - price) * 10000 // previous >= threshold_percentage
    WHEN 'direct_available' THEN is_direct AND price <= limit_price
    ELSE (config_min_price < 0 OR price >= config_min_price) AND (config_max_price IS NULL OR price <= config_max_price) END),
fired AS (SELECT rule_id, min(observed_at) AS at FROM trig GROUP BY 1
  UNION ALL SELECT x.rule_id, min(x.observed_at) FROM fired f JOIN trig x ON x.rule_id = f.rule_id
    AND x.observed_at > f.at + to_seconds(x.cooldown_seconds) GROUP BY x.rule_id)
SELECT t.rule_id, t.run_id, t.observed_at, t.price AS price_minor, t.previous AS previous_minimum
FROM fired f JOIN trig t ON t.rule_id = f.rule_id AND t.observed_at = f.at"""


def _fired() -> str:
    tables = sql("", o=_OBS, r=_RULES).strip()
    return _FIRED.replace("{tables}", tables.removeprefix("WITH "))


@query("stream_alerts", _fired())
def stream_alerts(t):
    """One stream reduces prices, in files that cut runs; another one evaluates runs once they are finished."""
    out, checkpoint = place(t, "alerts")
    jobs.run_prices(landed(t, observations), f"{out}/prices", f"{checkpoint}-prices")
    prices = jobs.resolve_run_prices(t.spark.read.parquet(f"{out}/prices"))
    rules = t.raw("customer").selectExpr(
        "c_custkey AS rule_id", "c_custkey AS query_id", "'CNY' AS currency",
        "element_at(array('price_threshold', 'new_low', 'absolute_drop', 'percentage_drop', 'direct_available', "
        "'round_trip_range'), cast(c_custkey % 6 AS int) + 1) AS rule_type",
        "c_custkey % 7 > 0 AS enabled", "1000 + (c_custkey % 5) * 500 AS threshold_price_minor",
        "500 + c_custkey % 9 * 1000 AS threshold_percentage", "c_custkey % 4 * 700 - 700 AS config_min_price",
        "CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 * 2000 END AS config_max_price",
        "86400 * (1 + c_custkey % 3) AS cooldown_seconds")
    finished = events(t).where("event_id % 5 = 4").selectExpr("event_id div 5 AS run_id")
    jobs.alerts(finished, prices, rules, f"{out}/events", checkpoint)
    return t.spark.read.parquet(f"{out}/events").drop(*jobs.BATCH_COLUMNS)


@query("resumable_backfill", sql("""
SELECT query_id, observation_date, currency, direct_only, lowest_price_minor, highest_price_minor, price_sum_minor,
  sample_count, first_observed_at, last_observed_at FROM daily
WHERE observation_date >= DATE '1998-01-01' AND observation_date < DATE '1998-04-01'"""))
def resumable_backfill(t):
    """Stopped after one month, then started again."""
    out, _ = place(t, "backfill")
    ob.write_observations(t.observations(), f"{out}/raw")
    months = [date(1998, m, 1) for m in (1, 2, 3)]
    for most in (1, None):
        jobs.backfill_daily_trend(t.spark, f"{out}/raw", f"{out}/daily", f"{out}/progress", months, most)
    return jobs.read_daily(t.spark, f"{out}/daily")
