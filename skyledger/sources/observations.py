"""Observation tables on disk: monthly partitions, hot and archived months."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.history import time_range


def month_of(moment: Column) -> Column:
    """First day of the UTC month."""
    return F.trunc(moment.cast("date"), "month")


def write_observations(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write monthly UTC partitions, sorted for reads by query and time.

    Rows are spread by month, query and day before the write, so a month is written
    by many tasks and a busy query does not fill one of them alone.
    """
    at = F.col("observed_at")
    (
        df.withColumn("obs_month", month_of(at))
        .repartition("obs_month", "query_id", F.to_date(at))
        .sortWithinPartitions("obs_month", "query_id", "observed_at")
        .write.mode(mode)
        .partitionBy("obs_month")
        .parquet(path)
    )


def read_observations(spark: SparkSession, path: str, start: datetime, end: datetime, *, closed: bool = True) -> DataFrame:
    """Observations of a time range; only its months are listed and read."""
    return time_range(spark.read.parquet(path), start, end, closed=closed)


def months_between(start: Column, end: Column) -> Column:
    """First days of all months from one moment to another."""
    return F.sequence(month_of(start), month_of(end), F.expr("INTERVAL 1 MONTH"))


def archive_overlap(partitions: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Months that overlap the half-open range."""
    first = F.col("month").cast("timestamp_ntz")
    after = F.add_months("month", 1).cast("timestamp_ntz")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return partitions.where((first < high) & (after > low))


def plan_partition_lifecycle(
    partitions: DataFrame, as_of: date, protected: DataFrame, *,
    archive_after: int = 24, purge_after: int | None = None, max_actions: int = 2,
) -> DataFrame:
    """Which months to purge or to archive next: purges first, oldest first.

    ``partitions`` holds parent, month and state (hot or archived). Price months
    that a protected range (range_start, range_end) needs are not purged. There is
    one row per month and table, so the plan is small.
    """
    if archive_after < 3:
        raise ValueError("at least three months must stay hot")
    if purge_after is not None and purge_after <= archive_after:
        raise ValueError("months must be archived before they are purged")
    if max_actions < 1:
        raise ValueError("at least one action must be allowed")
    anchor = as_of.replace(day=1)
    old = F.col("month") < F.add_months(F.lit(anchor), -archive_after)
    archive = partitions.where((F.col("state") == "hot") & old).withColumn("action", F.lit("archive"))
    plan = archive.withColumn("__order", F.lit(1))
    if purge_after is not None:
        gone = F.col("month") < F.add_months(F.lit(anchor), -purge_after)
        shielded = protected.select(F.explode(months_between(
            F.col("range_start"), F.col("range_end") - F.expr("INTERVAL 1 MICROSECOND"))).alias("month")).distinct()
        shielded = shielded.withColumn("parent", F.lit("price_observations"))
        purge = (
            partitions.where((F.col("state") == "archived") & gone)
            .join(shielded, ["parent", "month"], "left_anti")
            .withColumn("action", F.lit("purge"))
            .withColumn("__order", F.lit(0))
        )
        plan = plan.unionByName(purge.select(*plan.columns))
    return plan.orderBy("__order", "month", "parent").limit(max_actions).select("action", "parent", "month")


def archive_months(spark: SparkSession, hot: str, archive: str, months: Sequence[date]) -> int:
    """Copy closed months to the archive and check the copy; return the row count.

    The hot months are dropped (``drop_months``) only after this has returned.
    Running it again replaces the same archived months, so nothing is doubled.
    """
    wanted = [F.lit(m) for m in months]
    moved = spark.read.parquet(hot).where(F.col("obs_month").isin(*wanted))
    moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obs_month").parquet(archive)
    copied = spark.read.parquet(archive).where(F.col("obs_month").isin(*wanted))

    def digest(df: DataFrame):
        parts = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("x"))
        return tuple(parts.collect()[0])

    source, target = digest(moved), digest(copied)
    if source != target:
        raise RuntimeError(f"archive copy differs: {source} / {target}")
    return source[0]


def drop_months(spark: SparkSession, path: str, months: Sequence[date]) -> None:
    """Delete whole months of a table; a month that is not there is no fault."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for month in months:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/obs_month={month.isoformat()}"), True)


def read_hot_and_archive(hot: DataFrame, archive: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows of ``[start, end)`` from both; of the same (time, id) the hot row counts.

    Only months that both tables hold are compared row by row; all others are read as they
    are, without a shuffle. The lists of months have one row per month.
    """
    keys = ["observed_at", "obs_id"]
    young, old = (time_range(df, start, end, closed=False) for df in (hot, archive))
    held = F.broadcast(young.select("obs_month").distinct())
    doubled = F.broadcast(old.join(held, "obs_month", "left_semi").select("obs_month").distinct())
    alone = old.join(held, "obs_month", "left_anti")
    shared = old.join(held, "obs_month", "left_semi").join(
        young.join(doubled, "obs_month", "left_semi").select(*keys), keys, "left_anti"
    )
    return young.unionByName(alone).unionByName(shared)


def missing_source_months(
    manifest: DataFrame, runs: DataFrame, hot: DataFrame, archived: DataFrame, as_of: date,
    *, default_partition: bool = True,
) -> DataFrame:
    """Months that the runs of a manifest need and that neither table holds.

    A default partition takes the rows of the current and of later months.
    """
    needed = manifest.select("run_id").join(runs.select("run_id", "finished_at"), "run_id").select(
        month_of(F.col("finished_at")).alias("month")
    ).distinct()
    missing = needed.join(hot.select("month"), "month", "left_anti").join(
        archived.select("month"), "month", "left_anti"
    )
    if default_partition:
        missing = missing.where(F.col("month") < F.lit(as_of.replace(day=1)))
    return missing


def require_complete_months(hot_months: DataFrame, start: date, end: date) -> DataFrame:
    """Months of a range that are not hot; a rebuild must not start while any is left."""
    spark = hot_months.sparkSession
    bounds = spark.range(1).select(F.explode(months_between(F.lit(start), F.lit(end))).alias("month"))
    return bounds.join(hot_months.select("month"), "month", "left_anti")
