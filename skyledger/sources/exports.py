"""Exports: a frozen list of runs, safe CSV, JSON with metadata, and a summary."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.text import csv_safe

# The columns of an export, in order.
EXPORT_COLUMNS = (
    "schema_version", "scope", "subscription_id", "search_query_id", "provider", "trip_type", "origin",
    "destination", "departure_date", "return_date", "snapshot_at", "observation_id", "observed_at",
    "collection_run_id", "itinerary_id", "fare_offer_id", "offer_fingerprint", "currency",
    "total_price_minor", "is_lowest", "is_direct",
)
JSON_FIELDS = (
    "collection_run_id", "currency", "fare_offer_id", "is_direct", "is_lowest", "itinerary_id",
    "observation_id", "observed_at", "offer_fingerprint", "total_price_minor",
)


class ExportTooLarge(RuntimeError):
    """The export holds more rows or runs than allowed."""


def freeze_manifest(runs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Succeeded runs that finished in ``[start, end)``, with their query."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    done = (F.col("status") == "succeeded") & (F.col("finished_at") >= low) & (F.col("finished_at") < high)
    return runs.where(done).select("query_id", "run_id", "finished_at")


def frozen_manifest(runs: DataFrame, start: datetime, end: datetime, path: str, max_runs: int) -> DataFrame:
    """The manifest as it was when it was first asked for, stored in the order of query, time and run.

    A query with more than ``max_runs`` runs is refused, and nothing is stored then. Once
    stored, the manifest stays as it is, whatever happens to the runs.
    """
    spark = runs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        manifest = freeze_manifest(runs, start, end)
        too_large = manifest_overflow(manifest, max_runs).agg(F.count(F.lit(1)), F.max("runs")).first()
        if too_large[0]:
            raise ExportTooLarge(f"{too_large[0]} queries have up to {too_large[1]} runs, more than {max_runs}")
        ordered = manifest.repartitionByRange("query_id").sortWithinPartitions("query_id", "finished_at", "run_id")
        ordered.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest_overflow(manifest: DataFrame, max_runs: int) -> DataFrame:
    """Queries whose manifest is larger than one export may be."""
    return manifest.groupBy("query_id").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > max_runs)


def iso(column: str):
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def export_rows(observations: DataFrame, manifest: DataFrame, context_rows: DataFrame, legs: DataFrame,
                snapshot_at: datetime) -> DataFrame:
    """The export table of every subscription: observations of its frozen runs."""
    trip = legs.groupBy("query_id").agg(
        F.max(F.when(F.col("position") == 0, F.struct("origin", "destination", "departure_date"))).alias("out"),
        F.max(F.when(F.col("position") == 1, F.col("departure_date"))).alias("return_date"),
    )
    kept = observations.join(manifest.select("run_id"), "run_id", "left_semi")
    joined = kept.join(context_rows.select("subscription_id", "query_id", "provider", "trip_type"), "query_id").join(
        trip, "query_id"
    )
    values = {
        "schema_version": F.lit("1"), "scope": F.lit("canonical_query"), "search_query_id": F.col("query_id"),
        "origin": F.col("out.origin"), "destination": F.col("out.destination"),
        "departure_date": F.col("out.departure_date"),
        "snapshot_at": F.lit(snapshot_at).cast("timestamp_ntz"), "observation_id": F.col("obs_id"),
        "collection_run_id": F.col("run_id"), "fare_offer_id": F.col("offer_id"),
    }
    return joined.select(*[values.get(name, F.col(name)).alias(name) for name in EXPORT_COLUMNS])


def csv_table(rows: DataFrame) -> DataFrame:
    """Export rows as text cells; risky cells get a leading quote."""
    stamps = ("snapshot_at", "observed_at")
    flags = ("is_lowest", "is_direct")

    def cell(name: str):
        if name in stamps:
            return iso(name)
        if name in flags:
            return F.initcap(F.col(name).cast("string"))
        return csv_safe(F.col(name).cast("string"))

    return rows.select(*[cell(name).alias(name) for name in EXPORT_COLUMNS])


def check_rows(rows: DataFrame, max_rows: int | None) -> None:
    """Refuse an export above its row limit; it is never cut short."""
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ExportTooLarge(f"more than {max_rows} rows")


def export_csv(rows: DataFrame, path: str, max_rows: int | None = None) -> None:
    """CSV parts with LF line ends and a header each, partitioned by nothing else."""
    check_rows(rows, max_rows)
    csv_table(rows).write.mode("errorifexists").option("lineSep", "\n").csv(path, header=True, escape='"')


def export_json(rows: DataFrame, path: str, metadata: dict, max_rows: int | None = None) -> None:
    """JSON lines with keys in a fixed order, and one metadata line beside them."""
    check_rows(rows, max_rows)
    spark = rows.sparkSession
    body = rows.withColumn("observed_at", iso("observed_at")).select(*JSON_FIELDS)
    body.write.mode("errorifexists").json(f"{path}/observations")
    header = json.dumps(metadata, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
    spark.range(1).select(F.lit(header).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/metadata")


def export_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows, bytes and an order-free checksum of the text form of an export."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(rows.columns)])
    lines = rows.select(*keys, line.alias("line"))
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), (F.sum(F.octet_length("line") + 1)).alias("byte_count"),
        F.bit_xor(F.xxhash64("line")).alias("checksum"),
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Read an exported CSV back as text cells."""
    return spark.read.option("header", True).option("escape", '"').csv(path)
