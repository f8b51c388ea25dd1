"""Views of itineraries: connections, legs, and offers with nested parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connections(segments: DataFrame) -> DataFrame:
    """Each segment with layover and terminal change toward the next one of its leg.

    Positions run without gaps, so the next segment is found by an equi-join on
    ``position + 1``; no window has to hold a whole itinerary.
    """
    following = segments.select(
        "itinerary_id", "leg_position", (F.col("position") - 1).alias("position"),
        F.col("departure_utc").alias("next_departure"), F.col("origin_terminal").alias("next_terminal"),
    )
    joined = segments.join(following, ["itinerary_id", "leg_position", "position"])
    gap = F.timestamp_diff("SECOND", F.col("arrival_utc"), F.col("next_departure"))
    arrived = F.nullif(F.trim("destination_terminal"), F.lit(""))
    leaving = F.nullif(F.trim("next_terminal"), F.lit(""))
    return joined.select(
        "itinerary_id", "leg_position", "position",
        F.when(gap >= 0, F.floor((gap + 30) / 60).cast("bigint")).alias("layover_minutes"),
        F.when(arrived.isNotNull() & leaving.isNotNull(), arrived != leaving).alias("terminal_change"),
    )


def leg_summary(segments: DataFrame) -> DataFrame:
    """Origin, destination, times, stops and duration of every leg."""
    first = F.min_by(
        F.struct("flight_number", "marketing_airline", "origin", "departure_utc"), "position"
    )
    last = F.max_by(F.struct("destination", "arrival_utc"), "position")
    legs = segments.groupBy("itinerary_id", "leg_position").agg(
        first.alias("first"), last.alias("last"), F.count(F.lit(1)).alias("flown"),
        F.sum("technical_stop_count").alias("technical"), F.sum("duration_minutes").alias("in_air"),
    )
    elapsed = F.floor(
        F.timestamp_diff("SECOND", F.col("first.departure_utc"), F.col("last.arrival_utc")) / 60
    ).cast("bigint")
    return legs.select(
        "itinerary_id", "leg_position",
        F.when(F.col("leg_position") == 0, "outbound").otherwise("inbound").alias("direction"),
        F.col("first.flight_number").alias("flight_number"),
        F.col("first.marketing_airline").alias("airline"),
        F.col("first.origin").alias("origin"), F.col("last.destination").alias("destination"),
        F.col("first.departure_utc").alias("departure_at"), F.col("last.arrival_utc").alias("arrival_at"),
        (F.col("flown") - 1 + F.col("technical")).alias("stops"),
        F.when(elapsed > 0, elapsed).otherwise(F.col("in_air")).alias("duration_minutes"),
    )


def attach(parents: DataFrame, children: DataFrame, key: str, order: str, values: list[str], name: str) -> DataFrame:
    """Parents with the ordered array of their children; no child gives an empty array.

    Meant for children with a small bound per parent: legs of a query, segments
    of an itinerary, channels of a rule, routes of a view.
    """
    grouped = children.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, *values))).alias(name)
    )
    joined = parents.join(grouped, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def offer_detail(offers: DataFrame, segments: DataFrame) -> DataFrame:
    """Offers with nested legs, each leg with its segments."""
    hop = F.struct(
        "position", "flight_number", "marketing_airline", "origin", "destination",
        "departure_utc", "arrival_utc", "duration_minutes",
    )
    parts = segments.groupBy("itinerary_id", "leg_position").agg(
        F.array_sort(F.collect_list(hop)).alias("segments")
    )
    nested = leg_summary(segments).join(parts, ["itinerary_id", "leg_position"])
    values = [c for c in nested.columns if c not in ("itinerary_id", "leg_position")]
    return attach(offers, nested, "itinerary_id", "leg_position", values, "legs")


def readable_location(df: DataFrame, directory: DataFrame, code: str, name: str) -> DataFrame:
    """Add a readable name for a code; an unknown code stands for itself."""
    entries = directory.select(
        F.col("code").alias("__code"), "city", F.col("name").alias("__name"), "kind"
    )
    clean = F.upper(F.trim(F.col(code)))
    text = F.when(F.col("kind") == "city", F.concat_ws(" · ", "__name", "__code")).otherwise(
        F.concat(F.col("city"), F.lit(" · "), F.col("__name"), F.lit(" ("), F.col("__code"), F.lit(")"))
    )
    return (
        df.join(entries, clean == F.col("__code"), "left")
        .withColumn(name, F.when(F.col("__code").isNull(), clean).otherwise(text))
        .drop("__code", "city", "__name", "kind")
    )


def location_search(directory: DataFrame, text: str) -> DataFrame:
    """Entries whose code, names or aliases contain the text."""
    needle = F.lower(F.trim(F.lit(text)))
    fields = F.concat(F.array("code", "city", "name", "country"), F.col("aliases"))
    return directory.where(F.exists(fields, lambda f: F.contains(F.lower(f), needle)))
