"""Price samples per run, and price history by run, hour or day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.times import bucket_start, history_resolution
from skyledger.operators.filters import itinerary_match, with_branches, within
from skyledger.operators.paging import first_pages
from skyledger.skew import join_checked

RUN_KEYS = ("query_id", "currency", "run_id", "observed_at")


def time_range(observations: DataFrame, since: datetime, until: datetime, *, closed: bool = True) -> DataFrame:
    """Rows of ``[since, until]`` or ``[since, until)``.

    Tables written with a month column also get the month bounds, so that whole
    months are pruned before any file is opened.
    """
    at = F.col("observed_at")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (since, until))
    kept = observations.where((at >= low) & ((at <= high) if closed else (at < high)))
    if "obs_month" in observations.columns:
        months = [F.lit(x.date().replace(day=1)) for x in (since, until)]
        kept = kept.where(F.col("obs_month").between(*months))
    return kept


def run_floor(observations: DataFrame) -> DataFrame:
    """Cheapest price and cheapest direct price of every run and currency.

    The lowest-marked rows of a run hold the minimum of both groups, so a stored
    ``is_lowest`` column may be used to read less without changing the result.
    """
    if "is_lowest" in observations.columns:
        observations = observations.where("is_lowest")
    price = F.col("total_price_minor")
    return observations.groupBy(*RUN_KEYS).agg(
        F.min(price).alias("any_price"), F.min(F.when(F.col("is_direct"), price)).alias("direct_price")
    )


def simple_minima(floor: DataFrame, branch_rows: DataFrame, small: bool | None = None) -> DataFrame:
    """Run samples of branches without itinerary wishes.

    The floor already is one row per run, so a branch costs one row per run.
    """
    price = F.when(F.col("direct_only"), F.col("direct_price")).otherwise(F.col("any_price"))
    wanted = branch_rows.select("branch_key", "query_id", "currency", "direct_only", "max_price_minor")
    return (
        join_checked(floor, wanted, ["query_id", "currency"], small=small)
        .withColumn("price_minor", price)
        .where(F.col("price_minor").isNotNull() & within("max_price_minor", "price_minor"))
        .select("branch_key", "run_id", "observed_at", "price_minor")
    )


def scanned_minima(
    observations: DataFrame, features: DataFrame, branch_rows: DataFrame, small: bool | None = None
) -> DataFrame:
    """Run samples of branches whose wishes need itineraries and segments."""
    passing = with_branches(observations, features, branch_rows, small=small).where(
        itinerary_match()
        & (~F.col("direct_only") | F.col("is_direct"))
        & within("max_price_minor", "total_price_minor")
    )
    return passing.groupBy("branch_key", "run_id", "observed_at").agg(
        F.min("total_price_minor").alias("price_minor")
    )


def run_minima(
    observations: DataFrame, features: DataFrame, branch_rows: DataFrame, *, small: bool | None = None,
    wishes: bool | None = None,
) -> DataFrame:
    """One price sample per (branch, run): the cheapest price that passes.

    ``small`` tells that the branches are known to fit a broadcast. Itineraries and
    segments are left alone when no branch asks for them, which ``wishes`` tells if it is known.
    """
    simple = simple_minima(run_floor(observations), branch_rows.where("NOT needs_scan"), small)
    wishing = branch_rows.where("needs_scan")
    if wishing.isEmpty() if wishes is None else not wishes:
        return simple
    return simple.unionByName(scanned_minima(observations, features, wishing, small))


def history_summary(minima: DataFrame, *keys: str) -> DataFrame:
    """Minimum, maximum, average and count over all samples."""
    price = F.col("price_minor")
    return minima.groupBy(*keys).agg(
        F.min(price).alias("minimum_price_minor"),
        F.max(price).alias("maximum_price_minor"),
        F.avg(price).alias("average_price_minor"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def history_buckets(minima: DataFrame, resolution: str, *keys: str) -> DataFrame:
    """Samples by UTC hour or day."""
    price = F.col("price_minor")
    bucketed = minima.withColumn("bucket", bucket_start(F.col("observed_at"), resolution))
    return bucketed.groupBy(*keys, "bucket").agg(
        F.min(price).alias("lowest_price_minor"),
        F.max(price).alias("highest_price_minor"),
        F.avg(price).alias("average_price_minor"),
        F.count(F.lit(1)).alias("sample_count"),
    )


HISTORY_ORDER = ("observed_at", "run_id")


def history_at(minima: DataFrame, requested: str, days: int, *keys: str) -> DataFrame:
    """Raw samples, or buckets of the resolution that was asked for or that fits the window."""
    resolution = history_resolution(requested, days)
    return minima if resolution == "raw" else history_buckets(minima, resolution, *keys)


def history_pages(minima: DataFrame, limit: int, cursors: DataFrame | None = None) -> DataFrame:
    """A page of raw samples of every branch, by time and run."""
    return first_pages(minima, ["branch_key"], HISTORY_ORDER, limit, cursors=cursors)


def bucket_pages(buckets: DataFrame, limit: int, cursors: DataFrame | None = None) -> DataFrame:
    """A page of hour or day buckets of every branch."""
    return first_pages(buckets, ["branch_key"], ["bucket"], limit, cursors=cursors)


def for_subscriptions(per_branch: DataFrame, context_rows: DataFrame, how: str = "inner") -> DataFrame:
    """Give every subscription the rows of its branch."""
    members = context_rows.select("subscription_id", "branch_key")
    return members.join(per_branch, "branch_key", how).drop("branch_key")
