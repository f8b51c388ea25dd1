"""Collection runs: health, counters, pages, diagnostics, shape signals, planning."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.times import add_seconds, advance_due_at, bucket_index, retry_delay
from skyledger.operators.filters import (
    public_run_status, query_label, run_duration_ms, visible_runs, warning_code,
)
from skyledger.operators.paging import first_pages
from skyledger.session import cut_lineage
from skyledger.skew import fits_broadcast, join_checked

# Run states.
ACTIVE = ("pending", "leased", "running")
TERMINAL = ("succeeded", "failed", "canceled")


def _at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def per_user(runs: DataFrame, subscriptions: DataFrame, measures: dict[str, tuple[str, Column]],
             *, enabled_only: bool = False) -> DataFrame:
    """Sums and maxima over the visible runs of every user.

    Runs are reduced to one row per query before they meet the users that watch
    the query, so no row per (run, user) is made for subscribed queries.
    """
    reduce = {"sum": F.sum, "max": F.max}
    subs = subscriptions.where("enabled") if enabled_only else subscriptions
    watched = subs.select("user_id", "query_id").distinct()
    row_values = [value.alias(name) for name, (_, value) in measures.items()]
    per_query = runs.select("query_id", *row_values).groupBy("query_id").agg(
        *[reduce[how](name).alias(name) for name, (how, _) in measures.items()]
    )
    by_subscription = join_checked(watched, per_query, ["query_id"]).select("user_id", *measures)
    on_demand = (
        runs.select(F.explode(F.array_distinct("on_demand_user_ids")).alias("user_id"), "query_id", *row_values)
        .join(watched, ["user_id", "query_id"], "left_anti")
        .select("user_id", *measures)
    )
    return by_subscription.unionByName(on_demand).groupBy("user_id").agg(
        *[reduce[how](name).alias(name) for name, (how, _) in measures.items()]
    )


def collection_health(runs: DataFrame, subscriptions: DataFrame, now: datetime) -> DataFrame:
    """Last success, success share of the last 24 hours and next due time per user."""
    finished = F.col("finished_at")
    succeeded = F.col("status") == "succeeded"
    recent = F.col("status").isin(*TERMINAL) & finished.between(_at(now - timedelta(hours=24)), _at(now))
    measures = {
        "last_success_at": ("max", F.when(succeeded & (finished <= _at(now)), finished)),
        "succeeded_24h": ("sum", F.when(recent & succeeded, 1).otherwise(0).cast("bigint")),
        "terminal_24h": ("sum", F.when(recent, 1).otherwise(0).cast("bigint")),
    }
    stats = per_user(runs, subscriptions, measures, enabled_only=True)
    due = subscriptions.where("enabled").groupBy("user_id").agg(F.min("next_due_at").alias("next_scheduled_at"))
    users = subscriptions.select("user_id").distinct()
    rate = F.col("succeeded_24h").cast("double") / F.nullif(F.col("terminal_24h"), F.lit(0)).cast("double") * 100.0
    return (
        users.join(stats, "user_id", "left").join(due, "user_id", "left")
        .select("user_id", "last_success_at", rate.alias("success_rate_24h"), "next_scheduled_at")
    )


def run_status_counts(runs: DataFrame, subscriptions: DataFrame, now: datetime) -> DataFrame:
    """Ready, retrying, leased, running and recently failed runs per user."""
    status = F.col("status")
    waiting = status == "pending"
    tests = {
        "ready": waiting & (F.col("scheduled_at") <= _at(now)),
        "retrying": waiting & (F.col("scheduled_at") > _at(now)),
        "leased": status == "leased",
        "running": status == "running",
        "failed_24h": (status == "failed") & (F.col("finished_at") >= _at(now - timedelta(hours=24))),
    }
    measures = {
        name: ("sum", F.when(test, 1).otherwise(0).cast("bigint")) for name, test in tests.items()
    }
    return per_user(runs, subscriptions, measures)


def subscription_counts(subscriptions: DataFrame) -> DataFrame:
    """Enabled subscriptions and distinct tracked queries per user."""
    pairs = subscriptions.groupBy("user_id", "query_id").agg(F.count_if("enabled").alias("enabled"))
    return pairs.groupBy("user_id").agg(
        F.sum("enabled").alias("active_subscriptions"), F.count(F.lit(1)).alias("routes_tracked")
    )


def duration_percentiles(rows: DataFrame, value: str) -> DataFrame:
    """p50, p95 and p99 with linear interpolation.

    Equal values are counted; the counts of ``BUCKETS`` intervals, a list of fixed size, tell in which
    intervals the asked ranks lie, and only those intervals are sorted.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    low, high, total = counted.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    kind = dict(rows.dtypes)[value]
    ends = [F.lit(x).cast(kind).alias(n) for x, n in ((low, "min"), (high, "max"))]
    names = [f"p{round(100 * p)}" for p in PERCENTILES]
    if not total:
        return counted.agg(ends[0], *[F.lit(None).cast("double").alias(n) for n in names], ends[1])
    width = (high - low) / BUCKETS or 1.0
    bucket = F.least(F.floor((F.col("v") - low) / width), F.lit(BUCKETS - 1))
    sizes = counted.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).orderBy("b").collect()
    targets, before, at = [], 0, 0
    ranks = sorted({r for p in PERCENTILES for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))})
    for rank in ranks:
        while before + sizes[at]["n"] <= rank:
            before, at = before + sizes[at]["n"], at + 1
        targets.append((rank, sizes[at]["b"], rank - before))
    asked = counted.sparkSession.createDataFrame(targets, "rank bigint, b bigint, inside bigint")
    ordered = Window.partitionBy("b").orderBy("v")
    walked = (
        counted.withColumn("b", bucket).join(F.broadcast(asked.select("b").distinct()), "b", "left_semi")
        .withColumn("upto", F.sum("n").over(ordered))
    )
    found = walked.join(F.broadcast(asked), "b").where("upto > inside").groupBy("rank").agg(F.min("v").alias("v"))
    values = {r: F.max(F.when(F.col("rank") == r, F.col("v"))) for r in ranks}
    points = []
    for p, name in zip(PERCENTILES, names, strict=True):
        place = p * (total - 1)
        left, right = values[math.floor(place)], values[math.ceil(place)]
        points.append((left + (right - left) * (place - math.floor(place))).alias(name))
    return found.agg(ends[0], *points, ends[1])


PERCENTILES, BUCKETS = (0.5, 0.95, 0.99), 4096


RUN_ORDER = ("scheduled_at", "run_id")


def run_pages(
    runs: DataFrame, subscriptions: DataFrame, limit: int, cursors: DataFrame | None = None
) -> DataFrame:
    """The newest visible runs of every user, or those behind each user's cursor.

    Users are paired with the keys of runs alone, and these tell which runs lie on any page. Only those few runs are read
    with all their columns. A first page of a user can only hold the newest runs of each query, so there the
    keys are cut per query before they are joined to the users. On-demand runs are kept.
    """
    keys = list(RUN_ORDER)
    if cursors is not None:
        runs = runs.where(F.col(keys[0]) <= cursors.agg(F.max(keys[0])).first()[0]) if not cursors.isEmpty() else runs.limit(0)
    watched = subscriptions.select("user_id", "query_id").distinct()
    listed = runs.select("query_id", *keys)
    if cursors is None:
        listed = first_pages(listed, ["query_id"], keys, limit + 1, descending=True).select("query_id", *keys)
    subscribed = join_checked(listed, watched, ["query_id"]).select("user_id", *keys)
    asked = (
        runs.select(F.explode("on_demand_user_ids").alias("user_id"), "query_id", *keys)
        .join(watched, ["user_id", "query_id"], "left_anti")
        .select("user_id", *keys).dropDuplicates(["user_id", "run_id"])
    )
    seen = first_pages(
        subscribed.unionByName(asked), ["user_id"], keys, limit + 1, descending=True, most=101, cursors=cursors
    )
    paged = cut_lineage(seen.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct())
    on_page = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    near = runs.join(F.broadcast(paged) if fits_broadcast(paged) else paged, on_page, "left_semi")
    return first_pages(
        visible_runs(near, subscriptions), ["user_id"], keys, limit, descending=True, most=100, cursors=cursors)


def run_list_view(
    pages: DataFrame, queries: DataFrame, counts: DataFrame, shapes: DataFrame, diagnostics: DataFrame, health: DataFrame
) -> DataFrame:
    """Public columns of a page of runs, with what each run has stored and its user's health header.

    ``counts`` (stored rows), ``shapes`` (``schema_fingerprint``) and ``diagnostics`` are asked for
    the runs of the pages only.
    """
    known = queries.select("query_id", "provider", "trip_type", "query_hash")
    listed = pages.select("run_id").distinct()
    told = (
        diagnostics.join(listed, "run_id", "left_semi").groupBy("run_id")
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("from_last", "code", "severity")))).alias("diagnostics"))
    )
    stored = listed.join(counts, "run_id", "left").join(shapes, "run_id", "left").join(told, "run_id", "left")
    joined = pages.join(known, "query_id", "left").join(stored, "run_id", "left").join(health, "user_id", "left")
    return joined.select(
        "user_id", "run_id", "page_row", "has_more",
        query_label(F.col("provider"), F.col("trip_type"), F.col("query_hash")).alias("query_label"),
        F.coalesce("provider", F.lit("unknown")).alias("provider"),
        public_run_status(F.col("status")).alias("status"),
        F.coalesce("started_at", "scheduled_at").alias("started_at"), "finished_at", "attempt",
        run_duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"),
        warning_code(F.col("upstream_status"), F.col("partial_data")).alias("warning_code"), "error_code",
        "max_attempts", "upstream_status", "schema_fingerprint",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("calendar_count", "itinerary_count", "offer_count")],
        F.array_join(F.transform("diagnostics", lambda d: F.concat(d["code"], F.lit(":"), d["severity"])), ",").alias("diagnostics"),
        "last_success_at", "success_rate_24h", "next_scheduled_at",
    )


def run_diagnostics(issues: DataFrame, most: int = 20) -> DataFrame:
    """The last distinct issues of every run, parse issues before failure issues.

    Equal (code, message, path) keep their last occurrence.
    """
    code = F.substring(F.coalesce("code", "kind", F.lit("diagnostic")), 1, 120)
    flag = F.lower("retryable")
    rows = issues.select(
        "run_id", code.alias("code"), F.substring(F.coalesce("message", code), 1, 500).alias("message"),
        F.substring("path", 1, 240).alias("path"),
        F.when((F.col("severity") == "error") | (F.col("source") == "failure"), "error")
        .otherwise("warning").alias("severity"),
        F.substring("observed_type", 1, 120).alias("observed_type"),
        F.when(flag == "true", True).when(flag == "false", False).alias("retryable"),
        F.struct((F.col("source") == "failure").alias("late"), "seq").alias("place"),
    )
    last = rows.groupBy("run_id", "code", "message", "path").agg(
        F.max_by(F.struct("severity", "observed_type", "retryable"), "place").alias("v"), F.max("place").alias("place")
    )
    kept = first_pages(last, ["run_id"], ["place"], most, descending=True, most=100)
    backwards = F.col("page_row")
    return kept.select("run_id", "code", "message", "path", "v.severity", "v.observed_type", "v.retryable",
                       backwards.alias("from_last"))


def shape_signals(shapes: DataFrame, now: datetime) -> DataFrame:
    """State of every payload shape: new, current or historical for its endpoint."""
    newest = shapes.groupBy("provider", "endpoint").agg(
        F.max(F.struct("last_seen_at", "shape_fingerprint")).alias("__newest")
    )
    joined = shapes.join(newest, ["provider", "endpoint"])
    current = F.col("__newest.shape_fingerprint") == F.col("shape_fingerprint")
    fresh = F.col("first_seen_at") >= _at(now - timedelta(hours=24))
    state = F.when(current & fresh, "new").when(current, "current").otherwise("historical")
    return joined.withColumn("state", state).drop("__newest")


# -- planning ----------------------------------------------------------------


def due_subscriptions(subscriptions: DataFrame, now: datetime, batch: int | None = None) -> DataFrame:
    """Enabled subscriptions whose time has come, oldest first when a batch is asked."""
    due = subscriptions.where(F.col("enabled") & (F.col("next_due_at") <= _at(now)))
    return due if batch is None else due.orderBy("next_due_at", "subscription_id").limit(batch)


def due_by_query(
    subscriptions: DataFrame, queries: DataFrame, providers: DataFrame, runs: DataFrame,
    now: datetime, bucket_seconds: int = 900,
) -> DataFrame:
    """One collection request per due query that is not already being collected."""
    grouped = due_subscriptions(subscriptions, now).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("subscription_count"), F.min("next_due_at").alias("oldest_due_at")
    )
    active = runs.where(F.col("status").isin(*ACTIVE)).select("query_id").distinct()
    usable = providers.where("enabled").select(F.col("code").alias("provider"))
    bucket = bucket_index(_at(now), bucket_seconds).cast("string")
    return (
        grouped.join(queries.select("query_id", "provider"), "query_id")
        .join(usable, "provider", "left_semi")
        .join(active, "query_id", "left_anti")
        .withColumn(
            "idempotency_key",
            F.concat_ws(":", F.lit("scheduled"), F.col("query_id").cast("string"), bucket),
        )
    )


def advanced_due(subscriptions: DataFrame, now: datetime) -> DataFrame:
    """Due subscriptions with their next time on the old grid."""
    step = advance_due_at(F.col("next_due_at"), F.col("poll_interval_seconds"), _at(now))
    return due_subscriptions(subscriptions, now).withColumn("next_due_at", step)


def pending_runs(runs: DataFrame, now: datetime, batch: int | None = None) -> DataFrame:
    """Runs that may be handed out now, oldest first when a batch is asked."""
    ready = runs.where(
        (F.col("status") == "pending") & (F.col("scheduled_at") <= _at(now))
        & (F.col("attempt") < F.col("max_attempts"))
    )
    return ready if batch is None else ready.orderBy("scheduled_at", "run_id").limit(batch)


def expired_runs(runs: DataFrame, now: datetime) -> DataFrame:
    """Runs with an expired lease: pending again, or failed after the last attempt."""
    held = runs.where(F.col("status").isin("leased", "running") & (F.col("lease_expires_at") <= _at(now)))
    used_up = F.col("attempt") >= F.col("max_attempts")
    return held.select(
        "run_id", "query_id", F.col("status").alias("previous_status"),
        F.when(used_up, "failed").otherwise("pending").alias("status"),
        F.when(used_up, F.col("scheduled_at")).otherwise(_at(now)).alias("scheduled_at"),
        F.when(used_up, _at(now)).alias("finished_at"),
        F.when(used_up, "lease_expired_attempts_exhausted").alias("error_code"),
    )


def reuse_or_create(requests: DataFrame, runs: DataFrame, now: datetime, bucket_seconds: int = 900) -> DataFrame:
    """For each requested query: the active run, a success of this bucket, or a new key.

    One aggregate over the runs finds all three answers.
    """
    bucket = bucket_index(_at(now), bucket_seconds)
    start = add_seconds(F.lit("1970-01-01").cast("timestamp_ntz"), bucket * bucket_seconds)
    status = F.col("status")
    in_bucket = F.col("scheduled_at") >= start
    found = runs.groupBy("query_id").agg(
        F.max(F.when(status.isin(*ACTIVE), F.struct("scheduled_at", "run_id"))).alias("active"),
        F.max(F.when((status == "succeeded") & in_bucket & F.col("finished_at").isNotNull(),
                     F.struct("finished_at", "run_id"))).alias("recent"),
        F.count_if(status.isin("failed", "canceled") & in_bucket).alias("generation"),
    )
    key = F.concat_ws(
        ":", F.lit("on-demand"), "query_hash", bucket.cast("string"),
        F.coalesce("generation", F.lit(0)).cast("string"),
    )
    reused = F.coalesce(F.col("active.run_id"), F.col("recent.run_id"))
    return requests.join(found, "query_id", "left").select(
        "query_id", reused.alias("run_id"),
        F.when(F.col("active").isNotNull(), "active").when(F.col("recent").isNotNull(), "recent")
        .otherwise("new").alias("source"),
        F.when(reused.isNull(), key).alias("idempotency_key"),
    )


def retry_schedule(runs: DataFrame, base: float, maximum: float, jitter: Column | None = None) -> DataFrame:
    """When a failed run may be tried again; null after the last attempt.

    ``jitter`` (0 to 1, best from a hash of the run) spreads runs that failed together.
    """
    delay = F.ceil(retry_delay(F.col("attempt"), base, maximum, jitter=jitter)).cast("bigint")
    again = F.col("attempt") < F.col("max_attempts")
    return runs.where("status = 'failed'").select(
        "run_id", "attempt", F.when(again, delay).alias("delay_seconds"),
        F.when(again, add_seconds(F.col("finished_at"), delay)).alias("retry_at"),
    )


def run_outcome(runs: DataFrame) -> DataFrame:
    """Outcome from the stored counts of a run and its missing captures."""
    nothing = (F.col("calendar_count") == 0) & (F.col("observation_count") == 0)
    partial = (F.col("missing_captures") > 0) | (
        (F.col("calendar_count") > 0) & (F.col("observation_count") == 0)
    )
    warned = partial | (F.col("diagnostic_count") > 0)
    return (
        runs.withColumn("status", F.when(nothing, "failed").otherwise("succeeded"))
        .withColumn("error_code", F.when(nothing, "no_persistable_data"))
        .withColumn(
            "upstream_status",
            F.when(nothing, "schema_missing").when(warned, "success_with_warnings").otherwise("success"),
        )
        .withColumn("partial_data", ~nothing & partial)
    )


def quota_usage(jobs: DataFrame) -> DataFrame:
    """Active jobs, kept files and kept bytes of exports per user."""
    kept = F.col("status").isin("succeeded", "expired", "deleting") & F.col("file_name").isNotNull()
    size = F.when(kept, F.coalesce("size_bytes", F.lit(0))).otherwise(0)
    return jobs.groupBy("user_id").agg(
        F.count_if(F.col("status").isin("pending", "running")).alias("active_jobs"),
        F.count_if(kept).alias("kept_files"), F.sum(size).alias("kept_bytes"),
    )
