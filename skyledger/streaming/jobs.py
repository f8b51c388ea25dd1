"""Streaming jobs. Every sink can repeat a batch without changing its result.

A batch writes the partition of its stream and its number and overwrites it when it is run
again, or it rebuilds whole days. What is newest per key is streaming state. Progress lives in the checkpoint folder, and so does
the stream's id: a new checkpoint is another stream, so its batches, cut as they may be, never
overwrite those of an older one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyledger.functions.payload import shape_fingerprint
from skyledger.functions.times import bucket_start
from skyledger.operators.history import RUN_KEYS
from skyledger.operators.trends import DAILY_SCHEMA, daily_trend, trend_coverage
from skyledger.operators.writes import PRICE_KEYS, append_new
from skyledger.sources.observations import month_of


def stream_files(spark: SparkSession, folder: str, schema, glob: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process everything that is there now, then stop; the next start goes on from here."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def in_few_files(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a partition gather in as few files as their size asks for; a large one is still written by many tasks."""
    return df.hint("rebalance", *by) if by else df.hint("rebalance")


def write_batch(df: DataFrame, path: str, checkpoint: str, batch_id: int, *also_by: str) -> None:
    """Write one batch into its own partition, replacing an earlier try of the same stream."""
    stream = stream_id(df.sparkSession, checkpoint)
    numbered = df.withColumns({"stream_id": F.lit(stream), "batch_id": F.lit(batch_id).cast("bigint")})
    (
        in_few_files(numbered, *also_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("stream_id", "batch_id", *also_by).parquet(path)
    )


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not have been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


BATCH_FIELDS = (T.StructField("stream_id", T.StringType()), T.StructField("batch_id", T.LongType()))
BATCH_COLUMNS = tuple(f.name for f in BATCH_FIELDS)


def with_batch_id(schema: T.StructType) -> T.StructType:
    """The schema of a table whose rows carry their stream and the number of their batch."""
    return T.StructType([*schema.fields, *BATCH_FIELDS])


def store_new(rows: DataFrame, path: str, checkpoint: str, batch_id: int, keys: list[str], *also_by: str) -> None:
    """Store the rows of a batch whose key no other batch of any stream has stored.

    Only the ``also_by`` partitions that the batch touches are read back. What the batch
    itself stored in an earlier try does not count, as it is overwritten; what any
    other batch stored stays where it is. So no cut of a replay loses or doubles a row.
    """
    spark = rows.sparkSession
    stored = read_or_empty(spark, path, with_batch_id(rows.schema))
    own = (F.col("stream_id") == stream_id(spark, checkpoint)) & (F.col("batch_id") == batch_id)
    others = stored.where(~own)
    if also_by:
        others = others.join(rows.select(*also_by).distinct(), list(also_by), "left_semi")
    write_batch(append_new(others, rows, keys), path, checkpoint, batch_id, *also_by)


# -- idempotent ingest -----------------------------------------------------------


def ingest(captures: DataFrame, path: str, checkpoint: str, normalize: Callable[[DataFrame], DataFrame],
           keys: list[str]) -> None:
    """Normalize each capture once and append the rows whose key is new.

    A replay from an empty checkpoint, cut into other batches, adds nothing and loses nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = normalize(batch).withColumn("obs_month", month_of(F.col("observed_at")))
        store_new(rows, path, checkpoint, batch_id, keys, "obs_month")

    run_available(captures.writeStream.foreachBatch(step), checkpoint)


# -- newest wins -------------------------------------------------------------------


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cheapest: Sequence[str],
                   values: Sequence[str]) -> DataFrame:
    """One row per key: the greatest ``order`` values (numbers and times), and of those the least ``cheapest`` ones.

    A single minimum, so it adds up over tasks, batches and stored rows alike, in any cut.
    """
    kinds = dict(rows.dtypes)

    def descending(name: str):
        return -(F.unix_micros(F.col(name).cast("timestamp")) if kinds[name].startswith("timestamp") else F.col(name))

    rank = [descending(name).alias(f"rank_{k}") for k, name in enumerate(order)]
    kept = [name for name in values if name not in cheapest]
    best = F.min(F.struct(*rank, *cheapest, *kept)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[f"best.{name}" for name in values])


SNAPSHOT_VALUES = ("observed_at", "run_id", "total_price_minor", "offer_fingerprint", "itinerary_id", "offer_id")
STATE_VALUES = ("state", "observed_at", "event_id")


def snapshots_of(observations: DataFrame) -> DataFrame:
    """The cheapest offer of the newest run per query, currency and kind; of one run in two batches the cheaper offer stays."""
    return newest_per_key(observations, PRICE_KEYS, ["observed_at", "run_id"], ["total_price_minor", "offer_fingerprint"],
                          SNAPSHOT_VALUES)


def states_of(events: DataFrame) -> DataFrame:
    """The newest state of every run."""
    return newest_per_key(events, ["run_id"], ["observed_at", "event_id"], [], STATE_VALUES)


def keep_newest(rows: DataFrame, path: str, checkpoint: str, reduce: Callable[[DataFrame], DataFrame]) -> None:
    """Hold one row per key as streaming state, and store the keys that a batch touches.

    The state has one row per key however long the stream runs, and late rows never win. Stored rows are partial
    results of ``reduce``: ``read_newest`` reduces them once more, so neither a repeated batch
    nor a stream that starts again in other cuts changes what is read.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, checkpoint, batch_id)

    run_available(reduce(rows).writeStream.outputMode("update").foreachBatch(step), checkpoint)


def read_newest(spark: SparkSession, path: str, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(spark.read.parquet(path))


def compact_newest(spark: SparkSession, path: str, target: str, reduce: Callable[[DataFrame], DataFrame]) -> None:
    """Write the stored rows as a new table of one row per key, which ``read_newest`` reads as well."""
    read_newest(spark, path, reduce).write.parquet(target)


def latest_snapshots(observations: DataFrame, path: str, checkpoint: str) -> None:
    keep_newest(observations, path, checkpoint, snapshots_of)


def run_states(events: DataFrame, path: str, checkpoint: str) -> None:
    keep_newest(events, path, checkpoint, states_of)


# -- daily rows and hourly buckets ---------------------------------------------------


def rebuild_days(observations: DataFrame, raw_path: str, path: str, checkpoint: str, keys: list[str],
                 build: Callable[[DataFrame], DataFrame]) -> None:
    """Store each batch, then rebuild the days it touched from all stored rows.

    Rebuilding instead of adding makes repeats, late rows of any age and corrections safe.
    ``build`` makes rows with an ``observation_date`` from observations.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("observation_date", F.to_date("observed_at"))
        store_new(dated, raw_path, checkpoint, batch_id, keys, "observation_date")
        touched = dated.select("observation_date").distinct()
        stored = batch.sparkSession.read.schema(with_batch_id(dated.schema)).parquet(raw_path).drop(*BATCH_COLUMNS)
        rebuilt = build(stored.join(touched, "observation_date", "left_semi").drop("observation_date"))
        (
            in_few_files(rebuilt, "observation_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("observation_date").parquet(path)
        )

    run_available(observations.writeStream.foreachBatch(step), checkpoint)


def maintain_daily_trend(observations: DataFrame, raw_path: str, daily_path: str, checkpoint: str,
                         keys: list[str], coverage_path: str | None = None) -> None:
    """Daily rows of all days that a batch touches, and the coverage of their queries."""
    rebuild_days(observations, raw_path, daily_path, checkpoint, keys, daily_trend)
    if coverage_path is not None:
        rebuild_days(observations, raw_path, coverage_path, f"{checkpoint}-coverage", keys, observed_coverage)


def observed_coverage(observations: DataFrame) -> DataFrame:
    """The query days with observations: their daily rows have been rebuilt from all of them."""
    days = observations.select("query_id", F.to_date("observed_at").alias("observation_date")).distinct()
    return trend_coverage(days, observations)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAILY_SCHEMA).parquet(path)


HOURLY_SCHEMA = (
    "query_id LONG, bucket TIMESTAMP_NTZ, lowest_price_minor LONG, highest_price_minor LONG, price_sum_minor LONG, "
    "sample_count LONG, observation_date DATE"
)


def hourly_rows(observations: DataFrame) -> DataFrame:
    price = "total_price_minor"
    bucket = bucket_start(F.col("observed_at"), "hour").alias("bucket")
    return observations.groupBy("query_id", bucket).agg(
        F.min(price).alias("lowest_price_minor"), F.max(price).alias("highest_price_minor"),
        F.sum(price).alias("price_sum_minor"), F.count(F.lit(1)).alias("sample_count"),
    ).withColumn("observation_date", F.to_date("bucket"))


def hourly_history(observations: DataFrame, raw_path: str, path: str, checkpoint: str, keys: list[str]) -> None:
    """Hourly buckets as data arrives, however late it is."""
    rebuild_days(observations, raw_path, path, checkpoint, keys, hourly_rows)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOURLY_SCHEMA).parquet(path).drop("observation_date")


# -- visibility and shapes --------------------------------------------------------------


def visible_events(events: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str,
                   runs: DataFrame | None = None) -> None:
    """State changes for each user that may see the run; the checkpoint is the cursor.

    ``runs`` (``run_id, on_demand_user_ids``) adds the users that asked for a run themselves.
    """
    watched = subscriptions.select("user_id", "query_id").distinct()
    seen = events.join(watched, "query_id").select("user_id", "event_id", "query_id", "state", "observed_at")
    if runs is not None:
        # Whoever asked for a run sees it too, once.
        asked = runs.select("run_id", F.explode("on_demand_user_ids").alias("user_id")).distinct()
        by_hand = events.join(asked, "run_id").select("user_id", "event_id", "query_id", "state", "observed_at")
        seen = seen.unionByName(by_hand)

    def step(batch: DataFrame, batch_id: int) -> None:
        store_new(batch, path, checkpoint, batch_id, ["user_id", "event_id"])

    run_available(seen.writeStream.foreachBatch(step), checkpoint)


def new_shapes(captures: DataFrame, path: str, checkpoint: str) -> None:
    """Payload shapes at their first sight per endpoint."""
    shaped = captures.withColumn("shape_fingerprint", shape_fingerprint(F.col("payload")))
    first = shaped.where("shape_fingerprint IS NOT NULL").dropDuplicates(["endpoint", "shape_fingerprint"])
    rows = first.select("endpoint", "shape_fingerprint")

    def step(batch: DataFrame, batch_id: int) -> None:
        store_new(batch, path, checkpoint, batch_id, ["endpoint", "shape_fingerprint"])

    run_available(rows.writeStream.foreachBatch(step), checkpoint)


# -- alerts -----------------------------------------------------------------------------

_EVENT = "rule_id LONG, run_id LONG, observed_at TIMESTAMP_NTZ, price_minor LONG, previous_minimum LONG"
_STATE = "lowest LONG, last_event DOUBLE"
_RULE = ("rule_id", "query_id", "currency", "rule_type", "threshold_price_minor", "threshold_percentage",
         "config_min_price", "config_max_price", "cooldown_seconds")


def _number(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def _fires(row, lowest: int | None) -> bool:
    """The six rule types on one run, as ``operators.alerts`` has them for tables."""
    price, limit = row.price_minor, _number(row.threshold_price_minor)
    if row.rule_type == "price_threshold":
        return limit is not None and price <= limit
    if row.rule_type == "new_low":
        return lowest is None or price < lowest
    if row.rule_type == "direct_available":
        return bool(row.is_direct) and (limit is None or price <= limit)
    if row.rule_type == "round_trip_range":
        low, high = _number(row.config_min_price), _number(row.config_max_price)
        return (low is None or low < 0 or price >= low) and (high is None or high < 0 or price <= high)
    if lowest is None:
        return False
    if row.rule_type == "absolute_drop":
        return limit is not None and lowest - price >= limit
    if row.rule_type == "percentage_drop":
        points = _number(row.threshold_percentage)
        return points is not None and price < lowest and (lowest - price) * 10_000 // lowest >= points
    return False


def _watch(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One rule: keep the lowest price and the last event; emit what may be told."""
    lowest, last = state.get if state.exists else (None, None)
    fired = []
    runs = pd.concat(chunks).sort_values(["observed_at", "run_id"])
    for row in runs.itertuples(index=False):
        at = row.observed_at.timestamp()
        if _fires(row, lowest) and (last is None or at - last > row.cooldown_seconds):
            fired.append((key[0], row.run_id, row.observed_at, row.price_minor, lowest))
            last = at
        lowest = row.price_minor if lowest is None else min(lowest, row.price_minor)
    state.update((None if lowest is None else int(lowest), last))
    names = ["rule_id", "run_id", "observed_at", "price_minor", "previous_minimum"]
    yield pd.DataFrame(fired, columns=names).astype({"previous_minimum": "Int64"})


def alerts(finished: DataFrame, prices: DataFrame, rules: DataFrame, path: str, checkpoint: str) -> None:
    """Rules on each run as it is told finished, with the running minimum and the cooldown as state.

    ``finished`` is a stream of ``run_id``; ``prices`` are the resolved prices of all runs, which
    for a finished run are complete, in however many batches they came. A rule gets one
    row per run of the batch; batches are bounded by the files per trigger.
    """
    watched = rules.where("enabled").select(*_RULE)
    rows = finished.select("run_id").join(prices, "run_id").join(watched, ["query_id", "currency"]).select(
        "run_id", "observed_at", F.col("total_price_minor").alias("price_minor"), "is_direct",
        *[c for c in _RULE if c not in ("query_id", "currency")])
    fired = rows.groupBy("rule_id").applyInPandasWithState(
        _watch, _EVENT, _STATE, "append", GroupStateTimeout.NoTimeout
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        store_new(batch, path, checkpoint, batch_id, ["rule_id", "run_id"])

    run_available(fired.writeStream.outputMode("append").foreachBatch(step), checkpoint)


def run_prices(observations: DataFrame, path: str, checkpoint: str) -> None:
    """Cheapest price of every run that a batch brings, one row per run and batch."""
    cheapest = F.min(F.struct("total_price_minor", "is_direct")).alias("cheapest")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy(*RUN_KEYS).agg(cheapest).select(*RUN_KEYS, "cheapest.*")
        write_batch(rows, path, checkpoint, batch_id)

    run_available(observations.writeStream.foreachBatch(step), checkpoint)


def resolve_run_prices(rows: DataFrame) -> DataFrame:
    """One row per run: the cheapest of all its batches, and the time it was first seen."""
    keys = [k for k in RUN_KEYS if k != "observed_at"]
    return rows.groupBy(*keys).agg(
        F.min("observed_at").alias("observed_at"), F.min(F.struct("total_price_minor", "is_direct")).alias("x")
    ).select(*RUN_KEYS, "x.*")


# -- backfill ----------------------------------------------------------------------------


class SourceIncomplete(RuntimeError):
    """A month that the backfill needs is not there."""


class OtherScope(RuntimeError):
    """The progress belongs to another source, target or range."""


def stored_months(spark: SparkSession, path: str) -> set[date]:
    """Months of a table, from the names of its folders: no file is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return {date.fromisoformat(n.removeprefix("obs_month=")) for n in names if n.startswith("obs_month=")}


def backfill_daily_trend(spark: SparkSession, raw_path: str, daily_path: str, progress_path: str,
                         months: list[date], most: int | None = None, coverage_path: str | None = None) -> list[date]:
    """Rebuild daily rows, and the coverage of their query days, month by month; note each finished month.

    A restart goes on after the last noted month; at most one month is rebuilt
    twice, with the same result. Nothing is changed when a month is missing, or when the progress
    was made for another source, target or range. ``months`` is a short list; each month is one distributed job.
    """
    scope = f"{raw_path} {daily_path} {min(months)} {max(months)} {len(set(months))}"
    missing = sorted(set(months) - stored_months(spark, raw_path))
    if missing:
        raise SourceIncomplete(f"missing months: {missing}")
    progress = read_or_empty(spark, progress_path, "obs_month DATE, scope STRING").collect()
    if {r.scope for r in progress} - {scope}:
        raise OtherScope(f"the progress is of {progress[0].scope}")
    done = {r.obs_month for r in progress}
    raw = spark.read.parquet(raw_path)
    finished = []
    for month in sorted(set(months) - done)[:most]:
        rows = raw.where(F.col("obs_month") == F.lit(month)).drop("obs_month")
        outputs = [(daily_trend(rows), daily_path)]
        if coverage_path is not None:
            outputs.append((observed_coverage(rows), coverage_path))
        for output, path in outputs:
            (
                in_few_files(output, "observation_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("observation_date").parquet(path)
            )
        spark.createDataFrame([(month, scope)], "obs_month DATE, scope STRING").write.mode("append").parquet(progress_path)
        finished.append(month)
    return finished
