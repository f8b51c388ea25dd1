"""Local result filters, visibility and status columns.

A filter row holds one subscription's wishes. Subscriptions that share a query
and have the same wishes share one *branch*: the price work runs once per branch
and the result is joined back to the subscriptions.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.hashing import compact_key
from skyledger.session import cut_lineage
from skyledger.skew import join_checked, key_weights

WISHES = (
    "query_id", "currency", "direct_only", "airline_codes", "departure_airports", "arrival_airports",
    "max_price_minor", "max_stops", "max_duration_minutes", "departure_minute_start", "departure_minute_end",
)


def requires_itinerary_scan() -> Column:
    """True when the wishes can only be checked on itineraries and segments."""
    listed = [F.size(name) > 0 for name in ("airline_codes", "departure_airports", "arrival_airports")]
    bounded = [
        F.col(name).isNotNull()
        for name in ("max_stops", "max_duration_minutes", "departure_minute_start", "departure_minute_end")
    ]
    result = F.lit(False)
    for part in listed + bounded:
        result = result | part
    return result


def supports_daily_aggregate() -> Column:
    """True when maintained daily rows can answer for the wishes."""
    return ~requires_itinerary_scan() & F.col("max_price_minor").isNull()


def contexts(subscriptions: DataFrame, queries: DataFrame, filters: DataFrame) -> DataFrame:
    """Each subscription with its query, its wishes and the key of its branch."""
    codes = [
        F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)
        for name in ("airline_codes", "departure_airports", "arrival_airports")
    ]
    rest = [F.col(name) for name in WISHES[6:]]
    joined = subscriptions.join(queries, "query_id").join(
        filters.select("subscription_id", *codes, *rest), "subscription_id"
    )
    return joined.withColumn("branch_key", compact_key(**{name: F.col(name) for name in WISHES}))


def distinct_branches(rows: DataFrame) -> DataFrame:
    """The distinct branches of rows that hold wishes, written once.

    They decide which sources are read at all, and every source joins them.
    """
    return cut_lineage(
        rows.select("branch_key", *WISHES)
        .dropDuplicates(["branch_key"])
        .withColumn("needs_scan", requires_itinerary_scan())
    )


def branches(context_rows: DataFrame) -> DataFrame:
    """The distinct branches of the contexts."""
    return distinct_branches(context_rows)


def itinerary_features(itineraries: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per itinerary with all that the wishes look at.

    The airline set of an itinerary holds at most one code per segment.
    """
    outbound = F.col("leg_position") == 0
    first = outbound & (F.col("position") == 0)
    minute = (F.hour("departure_local") * 60 + F.minute("departure_local")).cast("bigint")
    flown = segments.groupBy("itinerary_id").agg(
        F.collect_set("marketing_airline").alias("airlines"),
        F.max(F.when(first, F.col("origin"))).alias("first_origin"),
        F.max(F.when(first, minute)).alias("first_minute"),
        F.max_by(F.when(outbound, F.col("destination")), F.when(outbound, F.col("position"))).alias(
            "last_destination"
        ),
    )
    kept = itineraries.select(
        "itinerary_id", "stop_count", "total_duration_minutes", F.col("is_direct").alias("direct_trip")
    )
    return kept.join(flown, "itinerary_id", "left")


def within(bound: str, value: str) -> Column:
    """Value at most the bound; a null bound lets everything pass."""
    return F.col(bound).isNull() | (F.col(value) <= F.col(bound))


def listed(codes: str, value: str) -> Column:
    """Value in the list; an empty list lets everything pass."""
    return (F.size(codes) == 0) | F.coalesce(F.array_contains(F.col(codes), F.col(value)), F.lit(False))


def airline_match() -> Column:
    """Any segment flown by a wished marketing airline."""
    return (F.size("airline_codes") == 0) | F.coalesce(
        F.arrays_overlap("airlines", "airline_codes"), F.lit(False)
    )


def departure_match() -> Column:
    """First outbound segment: wished airport, and local minute in the window.

    The window counts only when both ends are set.
    """
    asked = (F.size("departure_airports") > 0) | F.col("departure_minute_start").isNotNull()
    no_window = F.col("departure_minute_start").isNull() | F.col("departure_minute_end").isNull()
    in_window = (F.col("first_minute") >= F.col("departure_minute_start")) & (
        F.col("first_minute") < F.col("departure_minute_end")
    )
    matched = (
        F.col("first_origin").isNotNull()
        & listed("departure_airports", "first_origin")
        & (no_window | F.coalesce(in_window, F.lit(False)))
    )
    return ~asked | matched


def arrival_match() -> Column:
    """Last outbound segment lands at a wished airport."""
    return listed("arrival_airports", "last_destination")


def direct_match(is_direct: str = "direct_trip") -> Column:
    return ~F.col("direct_only") | F.col(is_direct)


def itinerary_match() -> Column:
    """All itinerary wishes of a branch on a row that holds the features."""
    return (
        direct_match()
        & within("max_stops", "stop_count")
        & within("max_duration_minutes", "total_duration_minutes")
        & airline_match()
        & departure_match()
        & arrival_match()
    )


def with_branches(
    offers: DataFrame, features: DataFrame, branch_rows: DataFrame, *, small: bool | None = None
) -> DataFrame:
    """Offers with their features, each with the branches of its query and currency."""
    on = ["query_id", "currency"]
    described = offers.join(features, "itinerary_id")
    return join_checked(described, branch_rows, on, small=small, weights=key_weights(offers, on))


def apply_fare_filters(
    offers: DataFrame, features: DataFrame, branch_rows: DataFrame, *, small: bool | None = None
) -> DataFrame:
    """Pairs of branch and offer where the offer passes the branch's wishes."""
    return with_branches(offers, features, branch_rows, small=small).where(
        itinerary_match() & within("max_price_minor", "total_price_minor")
    )


# -- visibility and status ---------------------------------------------------


def owner_scope(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def visible_runs(runs: DataFrame, subscriptions: DataFrame, *, enabled_only: bool = False) -> DataFrame:
    """Runs with each user that may see them, one row per (user, run).

    A user sees the runs of subscribed queries and the runs started on demand.
    """
    if enabled_only:
        subscriptions = subscriptions.where("enabled")
    watched = subscriptions.select("user_id", "query_id").distinct()
    by_subscription = join_checked(runs, watched, ["query_id"]).select("user_id", *runs.columns)
    on_demand = runs.select(F.explode("on_demand_user_ids").alias("user_id"), "*").join(
        watched, ["user_id", "query_id"], "left_anti"
    )
    repeated = on_demand.dropDuplicates(["user_id", "run_id"])
    return by_subscription.unionByName(repeated.select("user_id", *runs.columns))


def price_status(observed_at: Column, poll_seconds: Column, as_of: datetime) -> Column:
    """unavailable, stale (older than an hour and than two polls) or current."""
    limit = F.greatest(F.lit(3600), poll_seconds * 2).cast("bigint")
    age = F.timestamp_diff("MICROSECOND", observed_at, F.lit(as_of).cast("timestamp_ntz"))
    return (
        F.when(observed_at.isNull(), "unavailable")
        .when(age > limit * 1_000_000, "stale")
        .otherwise("current")
    )


def public_run_status(status: Column) -> Column:
    return (
        F.when(status == "succeeded", "success")
        .when(status == "failed", "failed")
        .when(status == "canceled", "blocked")
        .otherwise("running")
    )


def run_duration_ms(started_at: Column, finished_at: Column) -> Column:
    """Run time in milliseconds, never negative; null while a time is missing."""
    millis = F.floor(F.timestamp_diff("MICROSECOND", started_at, finished_at) / 1000).cast("bigint")
    return F.when(millis.isNotNull(), F.greatest(F.lit(0).cast("bigint"), millis))


def warning_code(upstream_status: Column, partial_data: Column) -> Column:
    return F.when((upstream_status == "success_with_warnings") & partial_data, "partial_fare_data")


def query_label(provider: Column, trip_type: Column, query_hash: Column) -> Column:
    label = F.concat_ws(" · ", provider, trip_type, F.substring(query_hash, 1, 8))
    return F.when(provider.isNull(), "Unknown search").otherwise(label)


def check_date_window(start, end, most_days: int = 366) -> None:
    if end < start:
        raise ValueError("the end of the range lies before its start")
    if (end - start).days > most_days:
        raise ValueError(f"the range is longer than {most_days} days")
