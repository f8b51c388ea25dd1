"""Reports that put several operators together, for all users in one job."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.filters import price_status
from skyledger.operators.itineraries import attach
from skyledger.operators.paging import first_pages


def route_states(context_rows: DataFrame, latest: DataFrame, as_of: datetime) -> DataFrame:
    """Every route with its latest price and how fresh it is."""
    newest = latest.select(
        "subscription_id", F.col("total_price_minor").alias("latest_price_minor"),
        F.col("observed_at").alias("latest_observed_at"),
    )
    status = price_status(F.col("latest_observed_at"), F.col("poll_interval_seconds"), as_of)
    return context_rows.join(newest, "subscription_id", "left").withColumn("price_status", status)


def comparison_snapshot(
    items: DataFrame, states: DataFrame, summaries: DataFrame, calendar_fares: DataFrame
) -> DataFrame:
    """Routes of every view in saved order: detailed numbers beside calendar prices.

    The two kinds of price stay in their own columns and are never mixed.
    """
    calendar = calendar_fares.select(
        "subscription_id",
        F.when(F.col("round_trip"), F.col("total_price_minor")).otherwise(F.col("lowest_price_minor")).alias(
            "calendar_price_minor"
        ),
        F.when(F.col("round_trip"), "round_trip_total").otherwise("one_way_lowest").alias("calendar_basis"),
        F.col("observed_at").alias("calendar_observed_at"),
    )
    routes = states.select(
        "subscription_id", "enabled", "trip_type", "currency", "direct_only", "latest_price_minor",
        "latest_observed_at", "price_status",
    )
    saved = items.select("view_id", "position", "subscription_id")
    return (
        saved.join(routes, "subscription_id")
        .join(summaries, "subscription_id", "left")
        .join(calendar, "subscription_id", "left")
    )


def comparison_series(
    items: DataFrame, context_rows: DataFrame, legs: DataFrame, detailed: DataFrame, calendar: DataFrame, as_of: datetime
) -> DataFrame:
    """Where every route of a view goes and when, and both its series over the view's trend days.

    A series has one point per day at most, so the arrays are bounded by the longest window.
    """
    place = F.struct("origin", "destination", "departure_date")
    ends = legs.groupBy("query_id").agg(
        F.min_by(place, "position").alias("out"), F.max(F.when(F.col("position") == 1, F.col("departure_date"))).alias("return_date")
    )
    routes = (
        items.select("view_id", "position", "subscription_id", "trend_days")
        .join(context_rows.select("subscription_id", "query_id"), "subscription_id")
        .join(ends, "query_id", "left")
        .select("view_id", "position", "subscription_id", "trend_days", "out.*", "return_date")
    )
    first = F.date_sub(F.lit(as_of).cast("date"), F.col("trend_days").cast("int"))
    for name, points in (("detailed_points", detailed), ("calendar_points", calendar)):
        points = points.select("subscription_id", "bucket", "lowest_price_minor")
        routes = attach(routes, points, "subscription_id", "bucket", ["lowest_price_minor"], name)
        routes = routes.withColumn(name, F.filter(name, lambda x: x["bucket"].cast("date") >= first))
    return routes.drop("trend_days")


def dashboard_view(overview: DataFrame, trend: DataFrame, routes: DataFrame) -> DataFrame:
    """The headline numbers of a user with the trend of all routes and each route's numbers, in order."""
    with_trend = attach(overview, trend, "user_id", "bucket", ["lowest_price_minor", "sample_count"], "trend")
    return attach(
        with_trend, routes, "user_id", "subscription_id", ["minimum_price_minor", "sample_count", "price_change_percent"], "routes"
    )


def dashboard_overview(
    counts: DataFrame, health: DataFrame, lowest: DataFrame, change: DataFrame
) -> DataFrame:
    """Headline numbers per user."""
    return (
        counts.join(health.select("user_id", "success_rate_24h"), "user_id", "left")
        .join(lowest.select("user_id", "lowest_price_minor"), "user_id", "left")
        .join(change.select("user_id", "price_change_percent"), "user_id", "left")
    )


def subscription_view(
    context_rows: DataFrame, legs: DataFrame, targets: DataFrame, as_of: datetime, limit: int = 20
) -> DataFrame:
    """Newest subscriptions of every user with wishes, ordered legs and target price."""
    seen = context_rows.where(F.col("created_at") <= F.lit(as_of).cast("timestamp_ntz"))
    page = first_pages(seen, ["user_id"], ["created_at", "subscription_id"], limit, descending=True)
    with_legs = attach(page, legs, "query_id", "position", ["origin", "destination", "departure_date"], "legs")
    return with_legs.join(targets, "subscription_id", "left")


def rule_view(rules: DataFrame, links: DataFrame, limit: int = 20) -> DataFrame:
    """Newest rules of every user with their channel ids."""
    page = first_pages(rules, ["user_id"], ["created_at", "rule_id"], limit, descending=True)
    return attach(page, links, "rule_id", "channel_id", [], "channels")


def operations_view(counts: DataFrame, signals: DataFrame, subscriptions: DataFrame, queries: DataFrame) -> DataFrame:
    """Run counters and counts of shape states per user, over the user's providers."""
    providers = subscriptions.join(queries.select("query_id", "provider"), "query_id").select(
        "user_id", "provider"
    ).distinct()
    per_provider = signals.groupBy("provider").agg(
        F.count_if(F.col("state") == "new").alias("new_shapes"),
        F.count_if(F.col("state") == "current").alias("current_shapes"),
        F.count_if(F.col("state") == "historical").alias("historical_shapes"),
    )
    shapes = providers.join(per_provider, "provider", "left").groupBy("user_id").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("new_shapes", "current_shapes", "historical_shapes")]
    )
    return counts.join(shapes, "user_id", "left")
