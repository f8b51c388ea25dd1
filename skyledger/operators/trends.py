"""Maintained daily rows, coverage, and the trends that are answered from them."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.money import average, percent_change
from skyledger.functions.times import bucket_start, full_utc_days
from skyledger.operators.history import run_floor, run_minima, simple_minima, time_range
from skyledger.operators.paging import page
from skyledger.session import cut_lineage
from skyledger.skew import BROADCAST_ROWS, join_checked

DAILY_KEYS = ("query_id", "observation_date", "currency", "direct_only")
DAILY_VALUES = (
    "lowest_price_minor", "highest_price_minor", "price_sum_minor", "sample_count",
    "first_observed_at", "last_observed_at",
)
DAILY_SCHEMA = (
    "query_id LONG, observation_date DATE, currency STRING, direct_only BOOLEAN, lowest_price_minor LONG, "
    "highest_price_minor LONG, price_sum_minor LONG, sample_count LONG, first_observed_at TIMESTAMP_NTZ, "
    "last_observed_at TIMESTAMP_NTZ"
)


def daily_trend(observations: DataFrame) -> DataFrame:
    """Exact daily summary of run minima per query, UTC day, currency and mode.

    The mode ``direct_only = false`` covers all offers, so both modes come from
    one pass: the run floor holds both minima, and a second aggregate keeps the
    numbers of both modes in one row, which is split at the end.
    """
    floor = run_floor(observations).withColumn("observation_date", F.to_date("observed_at"))

    def summary(price: str) -> list:
        seen = F.when(F.col(price).isNotNull(), F.col("observed_at"))
        parts = (
            F.min(price), F.max(price), F.sum(price), F.count(price), F.min(seen), F.max(seen),
        )
        return [part.alias(name) for part, name in zip(parts, DAILY_VALUES, strict=True)]

    def aggregate(price: str):
        return F.struct(*summary(price))

    wide = floor.groupBy("query_id", "observation_date", "currency").agg(
        aggregate("any_price").alias("all_modes"), aggregate("direct_price").alias("direct_mode")
    )
    modes = F.array(
        F.struct(F.lit(False).alias("direct_only"), F.col("all_modes").alias("v")),
        F.struct(F.lit(True).alias("direct_only"), F.col("direct_mode").alias("v")),
    )
    return (
        wide.select("query_id", "observation_date", "currency", F.explode(modes).alias("m"))
        .select("query_id", "observation_date", "currency", "m.direct_only", "m.v.*")
        .where("sample_count > 0")
    )


def tracked_days(subscriptions: DataFrame, start: date, end: date) -> DataFrame:
    """Every day of the range for every query that somebody subscribed to."""
    days = F.sequence(F.lit(start), F.lit(end))
    return subscriptions.select("query_id").distinct().withColumn("observation_date", F.explode(days))


def maintenance_page(
    query_days: DataFrame, limit: int, after: tuple[date, int] | None = None
) -> DataFrame:
    """The next query days to rebuild, by date and query, behind a stored cursor."""
    return page(query_days, ["observation_date", "query_id"], limit, after, most=10_000)


def trend_coverage(query_days: DataFrame, observations: DataFrame) -> DataFrame:
    """Proof that a query day was rebuilt, also when nothing was observed on it."""
    source = observations.where("is_lowest") if "is_lowest" in observations.columns else observations
    seen = source.groupBy("query_id", F.to_date("observed_at").alias("observation_date")).agg(
        F.max("observed_at").alias("source_last_observed_at")
    )
    return query_days.join(seen, ["query_id", "observation_date"], "left")


def covered_queries(coverage: DataFrame, start: date, end: date) -> DataFrame:
    """Queries whose covered days fill the half-open range of whole days."""
    expected = (end - start).days
    day = F.col("observation_date")
    return (
        coverage.where((day >= F.lit(start)) & (day < F.lit(end)))
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("covered_days"))
        .where(F.col("covered_days") == expected)
        .select("query_id")
    )


def split_by_coverage(
    branch_rows: DataFrame, coverage: DataFrame, since: datetime, as_of: datetime
) -> DataFrame:
    """Branches with ``covered``: daily rows answer for all whole days inside the range."""
    start, end = full_utc_days(since, as_of)
    daily_ok = ~F.col("needs_scan") & F.col("max_price_minor").isNull()
    if start == end:
        return branch_rows.withColumn("covered", F.lit(False))
    full = covered_queries(coverage, start.date(), end.date()).withColumn("full", F.lit(True))
    return (
        branch_rows.join(full, "query_id", "left")
        .withColumn("covered", daily_ok & F.coalesce(F.col("full"), F.lit(False)))
        .drop("full")
    )


def daily_points(minima: DataFrame) -> DataFrame:
    """Samples as partial sums per branch and UTC day."""
    price = F.col("price_minor")
    return minima.groupBy("branch_key", F.to_date("observed_at").alias("bucket")).agg(
        F.min(price).alias("lowest_price_minor"),
        F.max(price).alias("highest_price_minor"),
        F.sum(price).alias("price_sum_minor"),
        F.count(F.lit(1)).alias("sample_count"),
    )


POINT = ("branch_key", "bucket", "lowest_price_minor", "highest_price_minor", "price_sum_minor", "sample_count")


def trend_contributions(
    observations: DataFrame,
    features: DataFrame,
    branch_rows: DataFrame,
    daily: DataFrame,
    coverage: DataFrame,
    since: datetime,
    as_of: datetime,
    *,
    small: bool | None = None,
) -> DataFrame:
    """Partial daily points per branch from the cheapest exact source.

    Covered branches read daily rows for whole days and raw rows only for the two
    edges of the range. All other branches read the raw rows of their queries; when there are none, the
    raw rows of the whole range are not scanned. The time bounds of the edges are
    literals, so the edge scans prune to the months of their two days.
    The routed branches are written once while the plan is built, and both kinds counted.
    """
    start, end = full_utc_days(since, as_of)
    routed = cut_lineage(split_by_coverage(branch_rows, coverage, since, as_of))
    covered, uncovered = routed.where("covered"), routed.where("NOT covered")
    n_covered, n_uncovered, n_wishing = routed.agg(
        F.count_if("covered"), F.count_if(~F.col("covered")), F.count_if("needs_scan")
    ).first()
    if small is None:
        small = n_covered + n_uncovered <= BROADCAST_ROWS
    raw = time_range(observations, since, as_of)
    parts = []
    if n_uncovered or not n_covered:
        asked = uncovered.select("query_id").distinct()
        asked = F.broadcast(asked) if small else asked
        rows = raw.join(asked, "query_id", "left_semi")
        parts.append(daily_points(run_minima(rows, features, uncovered, small=small, wishes=n_wishing > 0)))
    if start < end and n_covered:
        day = F.col("observation_date")
        rows = daily.where((day >= F.lit(start.date())) & (day < F.lit(end.date())))
        wanted = covered.select("branch_key", "query_id", "currency", "direct_only")
        whole = join_checked(rows, wanted, ["query_id", "currency", "direct_only"], small=small)
        parts.append(whole.withColumn("bucket", day).select(*POINT))
        late = F.lit(max(end, since)).cast("timestamp_ntz")
        early = F.lit(start).cast("timestamp_ntz")
        at = F.col("observed_at")
        edges = raw.where((at < early) | (at >= late))
        parts.append(daily_points(simple_minima(run_floor(edges), covered, small)))
    result = parts[0].select(*POINT)
    for part in parts[1:]:
        result = result.unionByName(part.select(*POINT))
    return result


def raw_contributions(
    observations: DataFrame,
    features: DataFrame,
    branch_rows: DataFrame,
    since: datetime,
    as_of: datetime,
    *,
    small: bool | None = None,
) -> DataFrame:
    """The same points from raw rows only."""
    raw = time_range(observations, since, as_of)
    return daily_points(run_minima(raw, features, branch_rows, small=small)).select(*POINT)


def merge_points(points: DataFrame, *keys: str) -> DataFrame:
    """Merge partial points: minima, maxima, sums, and the exact average."""
    merged = points.groupBy(*keys, "bucket").agg(
        F.min("lowest_price_minor").alias("lowest_price_minor"),
        F.max("highest_price_minor").alias("highest_price_minor"),
        F.sum("price_sum_minor").alias("price_sum_minor"),
        F.sum("sample_count").alias("sample_count"),
    )
    return merged.withColumn(
        "average_price_minor", average(F.col("price_sum_minor"), F.col("sample_count"))
    )


def rolling_change(minima: DataFrame, as_of: datetime, *keys: str) -> DataFrame:
    """Cheapest sample of the last 24 hours against the 24 hours before."""
    at, price = F.col("observed_at"), F.col("price_minor")
    now_start = F.lit(as_of - timedelta(hours=24)).cast("timestamp_ntz")
    before_start = F.lit(as_of - timedelta(hours=48)).cast("timestamp_ntz")
    summary = minima.where((at >= before_start) & (at <= F.lit(as_of).cast("timestamp_ntz"))).groupBy(*keys).agg(
        F.min(F.when(at >= now_start, price)).alias("current_price_minor"),
        F.min(F.when(at < now_start, price)).alias("previous_price_minor"),
    )
    change = percent_change(F.col("current_price_minor"), F.col("previous_price_minor"))
    return summary.withColumn("price_change_percent", change)


def dashboard_trend(points: DataFrame, context_rows: DataFrame, currency: str) -> DataFrame:
    """One trend per user over the distinct branches that are on in the currency."""
    watched = (
        context_rows.where(F.col("enabled") & (F.col("currency") == currency))
        .select("user_id", "branch_key")
        .distinct()
    )
    merged = merge_points(watched.join(points, "branch_key"), "user_id")
    return merged.drop("price_sum_minor")


def dashboard_change(minima: DataFrame, context_rows: DataFrame, currency: str, as_of: datetime) -> DataFrame:
    """The 24-hour change of each user's dashboard."""
    watched = (
        context_rows.where(F.col("enabled") & (F.col("currency") == currency))
        .select("user_id", "branch_key")
        .distinct()
    )
    return rolling_change(watched.join(minima, "branch_key"), as_of, "user_id")


def route_trend(points: DataFrame, context_rows: DataFrame) -> DataFrame:
    """Daily trend of every subscription."""
    merged = merge_points(points, "branch_key").drop("price_sum_minor")
    return context_rows.select("subscription_id", "branch_key").join(merged, "branch_key").drop("branch_key")


def route_summary(points: DataFrame, minima: DataFrame, context_rows: DataFrame, as_of: datetime) -> DataFrame:
    """Period numbers and 24-hour change of every subscription.

    The change is empty for a route without any point in the period.
    """
    period = points.groupBy("branch_key").agg(
        F.min("lowest_price_minor").alias("minimum_price_minor"),
        F.max("highest_price_minor").alias("maximum_price_minor"),
        F.sum("price_sum_minor").alias("price_sum_minor"),
        F.sum("sample_count").alias("sample_count"),
    )
    rolling = rolling_change(minima, as_of, "branch_key").select("branch_key", "price_change_percent")
    per_branch = period.join(rolling, "branch_key", "left")
    joined = context_rows.select("subscription_id", "branch_key").join(per_branch, "branch_key", "left")
    return joined.select(
        "subscription_id", "minimum_price_minor", "maximum_price_minor",
        average(F.col("price_sum_minor"), F.col("sample_count")).alias("average_price_minor"),
        F.coalesce("sample_count", F.lit(0)).cast("bigint").alias("sample_count"),
        "price_change_percent",
    )


def verify_daily_trend(expected: DataFrame, stored: DataFrame, keys=DAILY_KEYS, values=DAILY_VALUES) -> DataFrame:
    """Row counts of both sides and the number of rows that differ."""
    left = expected.select(*keys, F.struct(*values).alias("want"))
    right = stored.select(*keys, F.struct(*values).alias("have"))
    both = left.join(right, list(keys), "full")
    return both.agg(
        F.count("want").alias("expected_rows"),
        F.count("have").alias("stored_rows"),
        F.count(F.when(~F.col("want").eqNullSafe(F.col("have")), 1)).alias("differences"),
    )


def verify_coverage(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """The same counts for coverage rows: a missing or stale row is a difference."""
    counts = verify_daily_trend(expected, stored, ("query_id", "observation_date"), ("source_last_observed_at",))
    return counts.toDF("expected_coverage_rows", "stored_coverage_rows", "coverage_differences")


def service_date_prices(observations: DataFrame, legs: DataFrame) -> DataFrame:
    """Prices by travel date: lowest, count, first and last time seen."""
    outbound = legs.where("position = 0").select("query_id", F.col("departure_date").alias("service_date"))
    per_query = observations.groupBy("query_id", "currency", "is_direct").agg(
        F.min("total_price_minor").alias("lowest_price_minor"),
        F.count(F.lit(1)).alias("sample_count"),
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("last_observed_at"),
    )
    return per_query.join(outbound, "query_id")


