"""Replays, late batches, archives, exports and streams on small tables."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.operators import runs as runs_operators
from skyledger.operators import trends, writes
from skyledger.session import work_dir
from skyledger.sources import exports, observations
from skyledger.sources.fixture import generate_observations
from skyledger.streaming import jobs

ANCHOR = datetime(2026, 3, 31, 9, 30)


@pytest.fixture(scope="module")
def obs(spark):
    return generate_observations(spark, 4, 200, 80, ANCHOR)


def test_append_new_twice_adds_nothing(spark, obs, plain):
    keys = ["observed_at", "run_id", "obs_id"]
    target = obs.where("query_id < 2")
    first = target.unionByName(writes.append_new(target, obs.unionByName(obs), keys))
    assert writes.append_new(first, obs, keys).count() == 0
    assert plain(first) == plain(obs)


def test_snapshots_do_not_depend_on_batch_order(spark, obs, plain):
    cut = F.lit(datetime(2026, 2, 20)).cast("timestamp_ntz")
    old, new = obs.where(F.col("observed_at") < cut), obs.where(F.col("observed_at") >= cut)
    whole = plain(writes.upsert_price_snapshot(None, obs))
    forward = writes.upsert_price_snapshot(writes.upsert_price_snapshot(None, old), new)
    backward = writes.upsert_price_snapshot(writes.upsert_price_snapshot(None, new), old)
    again = writes.upsert_price_snapshot(forward, obs)
    assert plain(forward) == plain(backward) == plain(again) == whole


def test_equal_time_replaces_and_null_returns_are_one_key(spark, plain):
    schema = ("query_id long, departure_date date, return_date date, currency string, observed_at timestamp_ntz, "
              "run_id long, lowest_price_minor long, total_price_minor long, fingerprint string")
    day, at = date(2026, 5, 1), datetime(2026, 4, 1)
    first = spark.createDataFrame([(1, day, None, "CNY", at, 1, 500, None, "a"), (1, day, None, "CNY", at, 1, 400, None, "b")], schema)
    second = spark.createDataFrame([(1, day, None, "CNY", at, 2, 900, None, "c")], schema)
    older = spark.createDataFrame([(1, day, None, "CNY", at - timedelta(1), 3, 100, None, "d")], schema)
    one = writes.upsert_calendar_snapshot(None, first)
    assert plain(one, "lowest_price_minor") == [(400,)]
    two = writes.upsert_calendar_snapshot(one, second)
    assert plain(two, "lowest_price_minor") == [(900,)]
    assert plain(writes.upsert_calendar_snapshot(two, older), "lowest_price_minor") == [(900,)]


def test_archive_keeps_every_row_and_prunes_months(spark, obs, plain):
    hot, cold = work_dir(spark, "t-hot"), work_dir(spark, "t-cold")
    observations.write_observations(obs, hot)
    months = [date(2026, 1, 1), date(2026, 2, 1)]
    moved = observations.archive_months(spark, hot, cold, months)
    assert moved == observations.archive_months(spark, hot, cold, months) > 0
    left = spark.read.parquet(hot).where("obs_month >= DATE'2026-02-01'")
    start, end = datetime(2026, 1, 5), datetime(2026, 3, 25)
    both = observations.read_hot_and_archive(left, spark.read.parquet(cold), start, end)
    want = obs.where((F.col("observed_at") >= F.lit(start).cast("timestamp_ntz"))
                     & (F.col("observed_at") < F.lit(end).cast("timestamp_ntz")))
    assert plain(both, "obs_id", "total_price_minor") == plain(want, "obs_id", "total_price_minor")
    narrow = observations.read_observations(spark, hot, datetime(2026, 3, 2), datetime(2026, 3, 3))
    assert "PartitionFilters: [isnotnull(obs_month" in narrow._jdf.queryExecution().executedPlan().toString()


def test_export_refuses_instead_of_cutting(spark, obs, tmp_path):
    rows = writes.mark_lowest(obs).selectExpr(
        "run_id AS collection_run_id", "currency", "offer_id AS fare_offer_id", "is_direct", "is_lowest", "itinerary_id",
        "obs_id AS observation_id", "observed_at", "offer_fingerprint", "total_price_minor")
    with pytest.raises(exports.ExportTooLarge):
        exports.export_json(rows, str(tmp_path / "big"), {}, max_rows=10)
    exports.export_json(rows, str(tmp_path / "all"), {"b": 1, "a": "ü"}, max_rows=800)
    lines = [line for f in (tmp_path / "all" / "observations").glob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == 800 and list(json.loads(lines[0])) == sorted(exports.JSON_FIELDS)
    header = next((tmp_path / "all" / "metadata").glob("*.txt")).read_text().strip()
    assert header == '{"a":"ü","b":1}'


def test_a_manifest_is_frozen_once_or_refused(spark, plain):
    schema = "query_id long, run_id long, status string, finished_at timestamp_ntz"
    day = datetime(2026, 1, 1)
    runs = spark.createDataFrame([(1, n, "succeeded", day + timedelta(hours=n)) for n in range(4)], schema)
    path, end = f"{work_dir(spark, 't-manifest')}/frozen", day + timedelta(days=1)
    with pytest.raises(exports.ExportTooLarge):
        exports.frozen_manifest(runs, day, end, path, 3)
    first = plain(exports.frozen_manifest(runs, day, end, path, 4))
    later = runs.unionByName(spark.createDataFrame([(1, 9, "succeeded", day)], schema))
    assert plain(exports.frozen_manifest(later, day, end, path, 1)) == first and len(first) == 4


def test_percentiles_of_spread_and_equal_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for values in (rng.lognormal(3, 3, 700), [5.0] * 9, [1.0, 2.0], [7.5], np.repeat([1.0, 1e9], [99, 2])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = runs_operators.duration_percentiles(df, "v").first()
        want = [np.min(values), *np.percentile(values, [50, 95, 99]), np.max(values)]
        assert np.allclose([got["min"], got["p50"], got["p95"], got["p99"], got["max"]], want)
    assert runs_operators.duration_percentiles(df.limit(0), "v").first()["p50"] is None


def test_suffixed_names_do_not_meet_plain_ones(spark):
    import hashlib

    suffix = hashlib.sha256(b"2").hexdigest()
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, f"abc-{suffix[:16]}"), (4, "abc")], "id long, name string")
    slugs = {r.id: r.slug for r in writes.unique_slugs(df, "name", "id").collect()}
    assert slugs[1] == "abc" and slugs[3] == f"abc-{suffix[:16]}" and len(set(slugs.values())) == 4


def test_lifecycle_limits(spark):
    parts = spark.createDataFrame([], "parent string, month date, state string")
    ranges = spark.createDataFrame([], "range_start timestamp_ntz, range_end timestamp_ntz")
    for wrong in ({"archive_after": 2}, {"purge_after": 24}, {"max_actions": 0}):
        with pytest.raises(ValueError):
            observations.plan_partition_lifecycle(parts, date(2026, 1, 1), ranges, **wrong)


KEYS = ["observed_at", "obs_id"]


def landed(spark, obs, name):
    """The rows in several files, the newest first, so that later batches are late."""
    folder = work_dir(spark, name)
    for low, high in ((20, 81), (5, 20), (0, 5)):
        age = F.datediff(F.lit(ANCHOR.date()), F.to_date("observed_at"))
        obs.where((age >= low) & (age < high)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_daily_trend_with_late_files_and_restart(spark, obs, plain):
    folder, base = landed(spark, obs, "t-land"), work_dir(spark, "t-daily")

    def start():
        stream = jobs.stream_files(spark, folder, obs.schema, "*.parquet", files_per_batch=1)
        jobs.maintain_daily_trend(stream, f"{base}/raw", f"{base}/daily", f"{base}/checkpoint", KEYS, f"{base}/coverage")
        return plain(jobs.read_daily(spark, f"{base}/daily"), *trends.DAILY_KEYS, *trends.DAILY_VALUES)

    want = plain(trends.daily_trend(obs), *trends.DAILY_KEYS, *trends.DAILY_VALUES)
    assert start() == want
    assert start() == want
    extra = obs.where("query_id = 0").withColumn("obs_id", F.concat(F.lit("x"), "obs_id")).withColumn(
        "total_price_minor", F.lit(7).cast("long"))
    extra.coalesce(1).write.mode("append").parquet(folder)
    days = spark.read.parquet(f"{base}/coverage").select("query_id", "observation_date")
    assert plain(days) == plain(obs.select("query_id", F.to_date("observed_at")).distinct())
    assert start() == plain(trends.daily_trend(obs.unionByName(extra)), *trends.DAILY_KEYS, *trends.DAILY_VALUES)


def test_stream_snapshot_ignores_late_rows(spark, obs, plain):
    folder, base = landed(spark, obs, "t-land2"), work_dir(spark, "t-snap")
    stream = jobs.stream_files(spark, folder, obs.schema, "*.parquet", files_per_batch=1)
    jobs.latest_snapshots(stream, f"{base}/out", f"{base}/checkpoint")
    columns = ("query_id", "currency", "is_direct", "observed_at", "total_price_minor")
    want = plain(writes.upsert_price_snapshot(None, obs), *columns)
    assert plain(jobs.read_newest(spark, f"{base}/out", jobs.snapshots_of), *columns) == want
    # Again from an empty checkpoint, in other cuts: what is read stays the same.
    stream = jobs.stream_files(spark, folder, obs.schema, "*.parquet", files_per_batch=2)
    jobs.latest_snapshots(stream, f"{base}/out", f"{base}/checkpoint-2")
    assert plain(jobs.read_newest(spark, f"{base}/out", jobs.snapshots_of), *columns) == want
    # No batch stores more than one row per key, and a compacted table has one row per key.
    batches = spark.read.parquet(f"{base}/out").groupBy("stream_id", "batch_id").count()
    assert max(r["count"] for r in batches.collect()) <= len(want)
    jobs.compact_newest(spark, f"{base}/out", f"{base}/compact", jobs.snapshots_of)
    assert spark.read.parquet(f"{base}/compact").count() == len(want)
    assert plain(jobs.read_newest(spark, f"{base}/compact", jobs.snapshots_of), *columns) == want


def test_of_one_run_in_two_batches_the_cheaper_offer_stays(spark, plain):
    schema = ("query_id long, currency string, is_direct boolean, observed_at timestamp_ntz, run_id long, total_price_minor long, "
              "offer_fingerprint string, itinerary_id string, offer_id string")
    at, base = datetime(2026, 4, 1), work_dir(spark, "t-split")
    rows = [(1, "CNY", True, at, 7, 90, "b", "i", "o"), (1, "CNY", True, at, 7, 80, "c", "j", "p"), (1, "CNY", True, at, 6, 10, "a", "k", "q"),
            (None, None, None, at, 5, 70, "z", "l", "r")]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    jobs.latest_snapshots(jobs.stream_files(spark, f"{base}/in", schema, "*.parquet", 1), f"{base}/out", f"{base}/checkpoint")
    got = plain(jobs.read_newest(spark, f"{base}/out", jobs.snapshots_of), "query_id", "run_id", "total_price_minor", "offer_id")
    assert got == sorted([(1, 7, 80, "p"), (None, 5, 70, "r")], key=repr)


def five_files(spark, rows, name):
    """The rows in five files, the newest first."""
    folder = work_dir(spark, name)
    ranked = rows.withColumn("part", F.pmod(F.xxhash64("obs_id"), F.lit(5)))
    for k in range(5):
        ranked.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.mark.parametrize("cuts", [(2, 3), (3, 1, 2), (5, 1), (1, 5, 1)])
def test_stream_ingest_replay_from_empty_checkpoints(spark, obs, plain, cuts):
    rows = obs.where("query_id < 2")
    folder, base = five_files(spark, rows, "t-land3"), work_dir(spark, "t-ingest")
    for number, files in enumerate(cuts):
        stream = jobs.stream_files(spark, folder, obs.schema, "*.parquet", files_per_batch=files)
        jobs.ingest(stream, f"{base}/out", f"{base}/checkpoint-{number}", lambda batch: batch, KEYS)
    assert plain(spark.read.parquet(f"{base}/out"), "obs_id") == plain(rows, "obs_id")


def test_stream_hourly_history_keeps_late_rows(spark, obs, plain):
    folder, base = landed(spark, obs, "t-land5"), work_dir(spark, "t-hourly")
    for files in (1, 2):
        stream = jobs.stream_files(spark, folder, obs.schema, "*.parquet", files_per_batch=files)
        jobs.hourly_history(stream, f"{base}/raw", f"{base}/out", f"{base}/checkpoint-{files}", KEYS)
    got = jobs.read_hourly(spark, f"{base}/out")
    assert got.agg(F.sum("sample_count")).first()[0] == obs.count()
    assert plain(got) == plain(jobs.hourly_rows(obs).drop("observation_date"))


def test_a_run_split_over_files_is_told_once_with_its_lowest_price(spark, plain):
    schema = "query_id long, currency string, run_id long, observed_at timestamp_ntz, total_price_minor long, is_direct boolean"
    at, base = datetime(2026, 4, 1), work_dir(spark, "t-alerts")
    for price in (90, 80):
        spark.createDataFrame([(1, "CNY", 7, at, price, False)], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = jobs.stream_files(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, "*.parquet", files_per_batch=1)
    jobs.run_prices(stream, f"{base}/prices", f"{base}/c1")
    spark.createDataFrame([(7,)], "run_id long").coalesce(1).write.parquet(f"{base}/finished")
    finished = jobs.stream_files(spark, f"{base}/finished", "run_id long", "*.parquet")
    rules = spark.createDataFrame(
        [(1, 1, "CNY", "price_threshold", 85, None, None, None, 0, True)],
        "rule_id long, query_id long, currency string, rule_type string, threshold_price_minor long, "
        "threshold_percentage long, config_min_price long, config_max_price long, cooldown_seconds long, enabled boolean")
    prices = jobs.resolve_run_prices(spark.read.parquet(f"{base}/prices"))
    jobs.alerts(finished, prices, rules, f"{base}/events", f"{base}/c2")
    assert plain(spark.read.parquet(f"{base}/events"), "run_id", "price_minor", "previous_minimum") == [(7, 80, None)]


def test_backfill_refuses_missing_months_and_resumes(spark, obs, plain):
    base = work_dir(spark, "t-backfill")
    observations.write_observations(obs, f"{base}/raw")
    paths = (f"{base}/raw", f"{base}/daily", f"{base}/progress")
    with pytest.raises(jobs.SourceIncomplete):
        jobs.backfill_daily_trend(spark, *paths, [date(2025, 1, 1)])
    months = [date(2026, 2, 1), date(2026, 1, 1)]
    assert jobs.backfill_daily_trend(spark, *paths, months, most=1) == [date(2026, 1, 1)]
    assert jobs.backfill_daily_trend(spark, *paths, months) == [date(2026, 2, 1)]
    assert jobs.backfill_daily_trend(spark, *paths, months) == []
    with pytest.raises(jobs.OtherScope):
        jobs.backfill_daily_trend(spark, *paths, [date(2026, 1, 1)])
    want = trends.daily_trend(obs).where("observation_date BETWEEN DATE'2026-01-01' AND DATE'2026-02-28'")
    assert plain(jobs.read_daily(spark, paths[1]), *trends.DAILY_KEYS) == plain(want, *trends.DAILY_KEYS)
