"""Calendar prices: prices of travel dates, kept apart from itinerary prices."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.filters import check_date_window
from skyledger.operators.history import time_range
from skyledger.operators.paging import first_pages
from skyledger.skew import join_checked

PAIR = ("query_id", "currency", "departure_date", "return_date")
# Stands for "no return" in join keys, which treat null as unequal.
NO_RETURN = "0001-01-01"


def route_dates(context_rows: DataFrame, legs: DataFrame) -> DataFrame:
    """Each subscription with its own exact travel dates."""
    dates = legs.groupBy("query_id").agg(
        F.max(F.when(F.col("position") == 0, F.col("departure_date"))).alias("departure_date"),
        F.max(F.when(F.col("position") == 1, F.col("departure_date"))).alias("second_date"),
    )
    round_trip = F.col("trip_type") == "round_trip"
    return context_rows.join(dates, "query_id").select(
        "subscription_id", "query_id", "currency", "departure_date",
        F.when(round_trip, F.col("second_date")).alias("return_date"), round_trip.alias("round_trip"),
    )


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("return_date", F.coalesce("return_date", F.lit(NO_RETURN).cast("date")))


def exact_pair(prices: DataFrame, routes: DataFrame) -> DataFrame:
    """Prices of exactly the wished dates: null returns match null returns."""
    pairs = routes.select(*PAIR, "round_trip").distinct()
    usable = pairs.where(~F.col("round_trip") | F.col("return_date").isNotNull())
    return join_checked(_with_key(prices), _with_key(usable), list(PAIR))


def latest_calendar_fares(snapshots: DataFrame, routes: DataFrame) -> DataFrame:
    """The stored newest price for the travel dates of every subscription."""
    found = exact_pair(snapshots, routes).drop("round_trip")
    return _with_key(routes).join(found, list(PAIR)).drop(*PAIR[2:], "query_id")


def observed_price() -> Column:
    """One way counts the lowest price, a round trip the total price."""
    return F.when(F.col("round_trip"), F.col("total_price_minor")).otherwise(F.col("lowest_price_minor"))


def calendar_trend(observations: DataFrame, routes: DataFrame, since: datetime, as_of: datetime) -> DataFrame:
    """Daily trend of run prices for the exact travel dates of every subscription.

    Round trips without a total price do not count.
    """
    matching = exact_pair(time_range(observations, since, as_of), routes)
    price = observed_price()
    per_run = (
        matching.where(price.isNotNull())
        .groupBy(*PAIR, "run_id")
        .agg(F.max("observed_at").alias("observed_at"), F.min(price).alias("price_minor"))
    )
    daily = per_run.groupBy(*PAIR, F.to_date("observed_at").alias("bucket")).agg(
        F.min("price_minor").alias("lowest_price_minor"),
        F.max("price_minor").alias("highest_price_minor"),
        F.avg("price_minor").alias("average_price_minor"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    return _with_key(routes).select("subscription_id", *PAIR).join(daily, list(PAIR)).drop(*PAIR)


def calendar_pages(
    snapshots: DataFrame, queries: DataFrame, start: date, end: date, limit: int,
    return_start: date | None = None, return_end: date | None = None, cursors: DataFrame | None = None,
) -> DataFrame:
    """A page of the calendar of every query, by departure and return.

    ``cursors`` has ``query_id, departure_date, return_date`` of the last rows that were seen.

    Round trips list only dated returns, one-way searches only rows without one.
    """
    check_date_window(start, end)
    rows = snapshots.join(queries.select("query_id", "currency", "trip_type"), ["query_id", "currency"])
    dated = F.col("return_date").isNotNull()
    rows = rows.where(
        F.col("departure_date").between(F.lit(start), F.lit(end))
        & (dated == (F.col("trip_type") == "round_trip"))
    )
    if return_start is not None:
        rows = rows.where(F.col("return_date") >= F.lit(return_start))
    if return_end is not None:
        rows = rows.where(F.col("return_date") <= F.lit(return_end))
    return_key = F.coalesce("return_date", F.lit(NO_RETURN).cast("date"))
    if cursors is not None:
        cursors = cursors.withColumn("return_key", return_key)
    pages = first_pages(
        rows.withColumn("return_key", return_key), ["query_id"], ["departure_date", "return_key"], limit, cursors=cursors
    )
    return pages.drop("return_key", "trip_type")


def shown_price() -> Column:
    return F.coalesce("total_price_minor", "lowest_price_minor")


def low_fare_calendar(points: DataFrame) -> DataFrame:
    """Cheapest point of every departure date, with its month."""
    best = F.min_by(
        F.struct("return_date", shown_price().alias("price_minor")),
        F.struct(shown_price(), F.coalesce("return_date", F.lit(NO_RETURN).cast("date"))),
    )
    return (
        points.groupBy("query_id", "currency", "departure_date")
        .agg(best.alias("best"))
        .select(
            "query_id", "currency", "departure_date",
            F.date_format("departure_date", "yyyy-MM").alias("month"), "best.*",
        )
    )


def date_pair_matrix(points: DataFrame, size: int = 12) -> DataFrame:
    """Cheapest price of the first departures and returns, with the minimum marked.

    The dates of a query are bounded by the calendar, so they are ranked after the
    rows have been reduced to one per date pair.
    """
    cells = points.where("return_date IS NOT NULL").groupBy(
        "query_id", "currency", "departure_date", "return_date"
    ).agg(F.min(shown_price()).alias("price_minor"))

    def first_dates(rows: DataFrame, column: str) -> DataFrame:
        kept = first_pages(rows.select("query_id", "currency", column).distinct(),
                           ["query_id", "currency"], [column], size)
        return kept.select("query_id", "currency", column)

    keys = ["query_id", "currency"]
    rows = cells.join(first_dates(cells, "departure_date"), [*keys, "departure_date"], "left_semi")
    grid = rows.join(first_dates(rows, "return_date"), [*keys, "return_date"], "left_semi")
    lowest = grid.groupBy(*keys).agg(F.min("price_minor").alias("__low"))
    return (
        grid.join(lowest, keys)
        .withColumn("is_minimum", F.col("price_minor") == F.col("__low"))
        .drop("__low")
    )
