"""Idempotent writes: append new keys, newest-wins snapshots, counters, fixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.text import slug_base
from skyledger.functions.times import add_seconds
from skyledger.operators.paging import least, newest
from skyledger.skew import salted_join


def append_new(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key the target does not hold yet, one per key."""
    fresh = batch.dropDuplicates(list(keys))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return fresh.alias("b").join(target.select(*keys).alias("t"), condition, "left_anti")


LOWEST_KEYS = ("run_id", "currency", "is_direct")


def mark_lowest(observations: DataFrame) -> DataFrame:
    """Mark every offer that has the lowest price of its run, currency and kind.

    A minimum per key joined back instead of a window: a run with very many offers
    is combined on the map side, and the join, with one row per key on one side, is
    split by adaptive execution where a key is hot. The input is read twice.
    """
    minima = observations.groupBy(*LOWEST_KEYS).agg(F.min("total_price_minor").alias("__low"))
    joined = observations.join(minima, list(LOWEST_KEYS))
    return joined.withColumn("is_lowest", F.col("total_price_minor") == F.col("__low")).drop("__low")


def newest_wins(target: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Merge a batch with one row per key into a snapshot; newer or equal wins.

    Grouping treats null keys as equal, which is what the snapshots need.
    """
    values = [c for c in batch.columns if c not in keys]
    rows = batch.withColumn("__new", F.lit(1))
    if target is not None:
        rows = target.select(*batch.columns).withColumn("__new", F.lit(0)).unionByName(rows)
    return newest(rows, keys, [*order, "__new"], values)


CALENDAR_KEYS = ("query_id", "departure_date", "return_date", "currency")


def calendar_batch(observations: DataFrame) -> DataFrame:
    """One row per date pair: the newest run of the batch, its lower price."""
    per_run = least(
        observations, [*CALENDAR_KEYS, "observed_at", "run_id"], ["lowest_price_minor", "fingerprint"],
        ["lowest_price_minor", "total_price_minor"],
    )
    return newest(
        per_run, CALENDAR_KEYS, ["observed_at", "run_id"],
        ["observed_at", "run_id", "lowest_price_minor", "total_price_minor"],
    ).withColumn("direct_verified", F.lit(False))


def upsert_calendar_snapshot(target: DataFrame | None, observations: DataFrame) -> DataFrame:
    return newest_wins(target, calendar_batch(observations), CALENDAR_KEYS, ["observed_at"])


PRICE_KEYS = ("query_id", "currency", "is_direct")


def price_batch(observations: DataFrame) -> DataFrame:
    """Cheapest offer of the newest run per query, currency and kind."""
    per_run = least(
        observations, [*PRICE_KEYS, "observed_at", "run_id"], ["total_price_minor", "offer_fingerprint"],
        ["total_price_minor", "offer_fingerprint", "itinerary_id", "offer_id"],
    )
    return newest(
        per_run, PRICE_KEYS, ["observed_at", "run_id"],
        ["observed_at", "run_id", "total_price_minor", "offer_fingerprint", "itinerary_id", "offer_id"],
    )


def upsert_price_snapshot(target: DataFrame | None, observations: DataFrame) -> DataFrame:
    return newest_wins(target, price_batch(observations), PRICE_KEYS, ["observed_at"])


SHAPE_KEYS = ("provider", "endpoint", "shape_fingerprint")


def upsert_shapes(target: DataFrame | None, captures: DataFrame) -> DataFrame:
    """First and last time and number of sightings of every payload shape."""
    batch = captures.select(
        *SHAPE_KEYS, F.col("observed_at").alias("first_seen_at"), F.col("observed_at").alias("last_seen_at"),
        F.lit(1).cast("bigint").alias("occurrence_count"),
    )
    rows = batch if target is None else target.select(*batch.columns).unionByName(batch)
    return rows.groupBy(*SHAPE_KEYS).agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.sum("occurrence_count").alias("occurrence_count"),
    )


def advance_subscriptions(subscriptions: DataFrame, finished: DataFrame) -> DataFrame:
    """Set last collection and next due time after the newest finished run."""
    done = finished.groupBy("query_id").agg(F.max("observed_at").alias("last_collected_at"))
    interval = F.col("poll_interval_seconds").cast("bigint")
    moved = F.col("enabled") & F.col("last_collected_at").isNotNull()
    return subscriptions.join(done, "query_id", "left").withColumn(
        "next_due_at",
        F.when(moved, add_seconds(F.col("last_collected_at"), interval)).otherwise(F.col("next_due_at")),
    )


def run_summary_counts(runs: DataFrame, calendar: DataFrame, itineraries: DataFrame,
                       offers: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """Stored rows per run, zero where nothing was stored; observations are counted where they are given.

    All sources go through one aggregate, so the runs are shuffled once.
    """
    frames = {"calendar_count": calendar, "itinerary_count": itineraries, "offer_count": offers}
    if observations is not None:
        frames["observation_count"] = observations
    names = list(frames)
    marks = [frame.select("run_id", F.lit(name).alias("kind")) for name, frame in frames.items()]
    rows = runs.select("run_id", F.lit("run").alias("kind"))
    for part in marks:
        rows = rows.unionByName(part)
    counts = [F.count_if(F.col("kind") == name).alias(name) for name in names]
    return rows.groupBy("run_id").agg(*counts, F.count_if(F.col("kind") == "run").alias("__runs")).where(
        "__runs > 0"
    ).drop("__runs")


def decouple_target_price(filters: DataFrame, rules: DataFrame) -> DataFrame:
    """Clear a price filter that only repeats its own target-price rule."""
    copied = rules.where("rule_type = 'price_threshold' AND config_source = 'subscription_target_price'").select(
        "subscription_id", F.col("threshold_price_minor").alias("max_price_minor"), F.lit(True).alias("__copied")
    ).where("max_price_minor IS NOT NULL").distinct()
    joined = filters.join(copied, ["subscription_id", "max_price_minor"], "left")
    return joined.withColumn(
        "max_price_minor", F.when(F.col("__copied").isNull(), F.col("max_price_minor"))
    ).drop("__copied").select(*filters.columns)


def unique_slugs(df: DataFrame, text: str, identifier: str, width: int = 64) -> DataFrame:
    """A unique name per row; all but the first row of equal names get a suffix.

    The suffix comes from the row's id, so the result does not depend on the row
    order. Hashing the whole id keeps suffixed names distinct; one that is another row's
    plain name gets a longer suffix.
    """
    named = df.withColumn("__base", slug_base(F.col(text), F.col(identifier), width))
    first = named.groupBy("__base").agg(F.min(identifier).alias("__first"), F.count(F.lit(1)).alias("weight"))
    marked = salted_join(named, first.drop("weight"), ["__base"], weights=first.select("__base", "weight"))
    suffix = F.sha2(F.col(identifier).cast("string"), 256)
    short = F.regexp_replace(F.substring("__base", 1, width - 17), r"[._\-]+$", "")
    plain = F.col(identifier) == F.col("__first")
    slug = F.when(plain, F.col("__base")).otherwise(F.concat(short, F.lit("-"), F.substring(suffix, 1, 16)))
    taken = first.select(F.col("__base").alias("slug"), F.lit(True).alias("__taken"))
    longer = F.concat(F.substring("__base", 1, max(1, width - 41)), F.lit("-"), F.substring(suffix, 1, 40))
    return (
        marked.withColumn("slug", slug)
        .join(taken, "slug", "left")
        .withColumn("slug", F.when(~plain & F.col("__taken").isNotNull(), longer).otherwise(F.col("slug")))
        .select(*df.columns, "slug")
    )
