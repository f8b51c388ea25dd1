"""Newest fares, offer lists and market snapshots."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.filters import apply_fare_filters
from skyledger.operators.history import for_subscriptions
from skyledger.operators.paging import first_pages, least, newest
from skyledger.skew import join_checked


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest succeeded run of every query, by finish time and id."""
    done = runs.where("status = 'succeeded' AND finished_at IS NOT NULL")
    return newest(done, ["query_id"], ["finished_at", "run_id"], ["run_id", "finished_at"])


def latest_offers(offers: DataFrame, runs: DataFrame) -> DataFrame:
    """Offers of the newest run of their query."""
    newest_runs = latest_runs(runs)
    return join_checked(offers.drop("finished_at"), newest_runs, ["query_id", "run_id"])


def only_itineraries(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """Itineraries or segments that some offer refers to."""
    return rows.join(offers.select("itinerary_id").distinct(), "itinerary_id", "left_semi")


def latest_fares(passing: DataFrame, context_rows: DataFrame) -> DataFrame:
    """Cheapest passing offer of the newest run, per subscription.

    ``passing`` holds the offers of newest runs that pass each branch. A branch
    without one gives no row: there is no fall back to an older run.
    """
    best = least(
        passing, ["branch_key"], ["total_price_minor", "offer_id"],
        ["run_id", "finished_at", "total_price_minor", "currency"],
    )
    return for_subscriptions(best, context_rows).withColumnRenamed("finished_at", "observed_at")


def passing_latest(
    offers: DataFrame, runs: DataFrame, features_of, branch_rows: DataFrame, *, small: bool | None = None
) -> DataFrame:
    """Offers of newest runs that pass each branch.

    ``features_of`` gets the offers kept and returns their itinerary features, so
    that only itineraries of newest runs are described.
    """
    kept = latest_offers(offers, runs)
    return apply_fare_filters(kept, features_of(kept), branch_rows, small=small)


def offer_totals(passing: DataFrame) -> DataFrame:
    """Exact number of matching offers per branch."""
    return passing.groupBy("branch_key").agg(F.count(F.lit(1)).alias("total"))


OFFER_ORDER = ("total_price_minor", "offer_id")


def offer_pages(passing: DataFrame, limit: int, cursors: DataFrame | None = None) -> DataFrame:
    """A page of every branch, cheapest first."""
    return first_pages(passing, ["branch_key"], OFFER_ORDER, limit, most=100, cursors=cursors)


def market_snapshot(legs: DataFrame, snapshots: DataFrame, today: date, limit: int, days: int = 180) -> DataFrame:
    """Cheapest latest prices of every origin and destination in the coming days."""
    day = F.col("departure_date")
    outbound = legs.where(
        (F.col("position") == 0) & (day >= F.lit(today)) & (day < F.lit(today + timedelta(days=days)))
    ).select("query_id", "origin", "destination", day.alias("service_date"))
    priced = outbound.join(snapshots, "query_id")
    keys = ["total_price_minor", "service_date", "query_id", "is_direct"]
    return first_pages(priced, ["origin", "destination"], keys, limit).drop("has_more")


def lowest_route_price(latest: DataFrame) -> DataFrame:
    """Lowest latest price per user, only when all priced routes share a currency."""
    return latest.groupBy("user_id").agg(
        F.when(F.min("currency") == F.max("currency"), F.min("total_price_minor")).alias("lowest_price_minor"),
        F.count(F.lit(1)).alias("priced_routes"),
    )
