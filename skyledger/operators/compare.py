"""Saved comparison views: state, checks, sorting and aligned trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of saved views.
MOST_ROUTES = 8
TREND_DAYS = (7, 30, 90)
SORTS = {
    "position": (None, False),
    "detailed-low": ("latest_price_minor", False),
    "detailed-high": ("latest_price_minor", True),
    "calendar-low": ("calendar_price_minor", False),
    "calendar-high": ("calendar_price_minor", True),
    "period-low": ("minimum_price_minor", False),
    "change-low": ("price_change_percent", False),
    "change-high": ("price_change_percent", True),
    "freshness": ("freshness", False),
}


def view_state(items: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Active and missing routes of every view, and whether it can be compared."""
    alive = items.join(
        subscriptions.select("subscription_id", F.lit(1).alias("__alive")), "subscription_id", "left"
    )
    counted = alive.groupBy("view_id", "configured_route_count").agg(F.count("__alive").alias("active_routes"))
    missing = F.greatest(F.lit(0), F.col("configured_route_count") - F.col("active_routes"))
    return counted.select(
        "view_id", "active_routes", missing.alias("missing_routes"),
        (F.col("active_routes") >= 2).alias("comparable"),
    )


def validate_views(items: DataFrame, context_rows: DataFrame) -> DataFrame:
    """First reason that keeps a view from being saved, or null.

    A view needs 2 to 8 unique known routes, one currency, and known trend days.
    """
    known = context_rows.select("subscription_id", "currency")
    rows = items.where("subscription_id IS NOT NULL").join(known, "subscription_id", "left")
    per_view = rows.groupBy("view_id", "trend_days").agg(
        F.count(F.lit(1)).alias("routes"),
        F.count_distinct("subscription_id").alias("unique_routes"),
        F.count("currency").alias("known_routes"),
        F.min("currency").alias("first_currency"), F.max("currency").alias("last_currency"),
    )
    problem = (
        F.when(F.col("unique_routes") < 2, "too_few_routes")
        .when(F.col("unique_routes") > MOST_ROUTES, "too_many_routes")
        .when(F.col("unique_routes") != F.col("routes"), "routes_not_unique")
        .when(F.col("known_routes") != F.col("routes"), "route_not_found")
        .when(F.col("first_currency") != F.col("last_currency"), "currencies_differ")
        .when(~F.col("trend_days").isin(*TREND_DAYS), "invalid_trend_days")
    )
    return per_view.select("view_id", F.col("unique_routes").alias("routes"), problem.alias("problem"))


def freshness_rank(status: Column) -> Column:
    return F.when(status == "current", 0).when(status == "stale", 1).otherwise(2)


def sort_routes(routes: DataFrame, mode: str) -> DataFrame:
    """Place of every route in its view; missing values go last both ways.

    A view holds at most eight routes, so ranking inside a view is cheap.
    """
    column, descending = SORTS[mode]
    order = [F.col("position").asc()]
    if column is not None:
        value = freshness_rank(F.col("price_status")) if column == "freshness" else F.col(column)
        order.insert(0, value.desc_nulls_last() if descending else value.asc_nulls_last())
    place = F.row_number().over(Window.partitionBy("view_id").orderBy(*order))
    return routes.withColumn("place", place.cast("bigint"))


def align_trends(items: DataFrame, trends: DataFrame) -> DataFrame:
    """One row per view and day with a column per route place; gaps stay null.

    A place beyond the last column fails the job; ``validate_views`` finds such views before.
    """
    place = F.when(F.col("position").between(0, MOST_ROUTES - 1), F.col("position")).otherwise(
        F.raise_error(F.lit("a view holds more routes than there are places"))
    )
    points = items.select("view_id", place.alias("position"), "subscription_id").join(
        trends.select("subscription_id", "bucket", "lowest_price_minor"), "subscription_id"
    )
    places = list(range(MOST_ROUTES))
    wide = points.groupBy("view_id", "bucket").pivot("position", places).agg(F.min("lowest_price_minor"))
    return wide.select("view_id", "bucket", *[F.col(str(p)).alias(f"route_{p}") for p in places])


def preferred_track(items: DataFrame, detailed: DataFrame, calendar: DataFrame) -> DataFrame:
    """``calendar`` only for views without any detailed point."""
    places = items.select("view_id", "subscription_id")
    has_detail = detailed.select("subscription_id").distinct().withColumn("d", F.lit(True))
    has_calendar = calendar.select("subscription_id").distinct().withColumn("c", F.lit(True))
    joined = places.join(has_detail, "subscription_id", "left").join(has_calendar, "subscription_id", "left")
    flags = joined.groupBy("view_id").agg(
        F.coalesce(F.bool_or("d"), F.lit(False)).alias("d"), F.coalesce(F.bool_or("c"), F.lit(False)).alias("c")
    )
    return flags.select(
        "view_id", F.when(~F.col("d") & F.col("c"), "calendar").otherwise("detailed").alias("track")
    )
