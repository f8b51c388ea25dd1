"""Partitions, archives and exports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from catalog.duck import sql
from catalog.history import contexts
from catalog.registry import query
from skyledger.operators import writes as wr
from skyledger.session import work_dir
from skyledger.sources import exports as ex
from skyledger.sources import observations as ob

START, END = datetime(1998, 1, 10, 6), datetime(1998, 6, 20, 18)
_RANGE = "observed_at >= TIMESTAMP '1998-01-10 06:00' AND observed_at < TIMESTAMP '1998-06-20 18:00'"
_OBS_OUT = "obs_id, observed_at, query_id, run_id, currency, total_price_minor"


@query("write_observations", sql(f"""
SELECT obs_month, count(*) AS n, sum(total_price_minor)::BIGINT AS total FROM (
  SELECT *, date_trunc('month', observed_at)::DATE AS obs_month FROM obs WHERE {_RANGE}) GROUP BY 1"""))
def write_observations(t):
    path = work_dir(t.spark, "observations")
    ob.write_observations(t.observations(), path)
    kept = ob.read_observations(t.spark, path, START, END, closed=False)
    return kept.groupBy("obs_month").agg(F.count(F.lit(1)).alias("n"), F.sum("total_price_minor").alias("total"))


@query("hot_archive_union", sql(f"SELECT {_OBS_OUT} FROM obs WHERE {_RANGE}"))
def hot_archive_union(t):
    """Old months are archived, two months lie in both tables; each row counts once."""
    hot, cold = work_dir(t.spark, "hot"), work_dir(t.spark, "archive")
    ob.write_observations(t.observations(), hot)
    ob.archive_months(t.spark, hot, cold, [date(1998, m, 1) for m in (1, 2, 3)])
    archived = t.spark.read.parquet(cold).withColumn(
        "total_price_minor", F.when(F.col("obs_month") == F.lit(date(1998, 3, 1)), -1).otherwise(
            F.col("total_price_minor")).cast("bigint"))
    ob.drop_months(t.spark, hot, [date(1998, 1, 1), date(1998, 2, 1)])
    left = t.spark.read.parquet(hot)
    both = ob.read_hot_and_archive(left, archived, START, END)
    return both.select("obs_id", "observed_at", "query_id", "run_id", "currency", "total_price_minor")


def months(t, state: str, keep: str):
    return t.runs().where("finished_at IS NOT NULL").select(
        ob.month_of(F.col("finished_at")).alias("month")).distinct().where(keep).select(
        F.explode(F.array(F.lit("price_observations"), F.lit("calendar_price_observations"))).alias("parent"),
        "month", F.lit(state).alias("state"))


@query("partition_lifecycle", sql("""
SELECT action, parent, month FROM (
  SELECT 'archive' AS action, parent, month, 1 AS o FROM months WHERE month >= DATE '1996-01-01' AND month < DATE '1996-06-01'
  UNION ALL SELECT 'purge', parent, month, 0 FROM months WHERE month < DATE '1995-06-01'
    AND NOT (parent = 'price_observations' AND month BETWEEN DATE '1995-02-01' AND DATE '1995-04-01'))
ORDER BY o, month, parent LIMIT 9""", months="""
  SELECT DISTINCT date_trunc('month', finished_at)::DATE AS month, unnest(['price_observations','calendar_price_observations'])
    AS parent FROM run WHERE finished_at IS NOT NULL"""))
def partition_lifecycle(t):
    parts = months(t, "hot", "month >= DATE'1996-01-01'").unionByName(
        months(t, "archived", "month < DATE'1996-01-01'"))
    shield = t.runs().where("finished_at IS NOT NULL").agg(F.min("finished_at").alias("m")).select(
        (F.trunc("m", "month") + F.expr("INTERVAL 50 DAY")).cast("timestamp_ntz").alias("range_start"),
        (F.trunc("m", "month") + F.expr("INTERVAL 100 DAY")).cast("timestamp_ntz").alias("range_end"))
    return ob.plan_partition_lifecycle(
        parts, date(1998, 6, 30), shield, archive_after=24, purge_after=36, max_actions=9)


@query("archive_overlap", sql("""
SELECT DISTINCT date_trunc('month', finished_at)::DATE AS month FROM run
WHERE finished_at >= TIMESTAMP '1998-01-01' AND finished_at < TIMESTAMP '1998-07-01'"""))
def archive_overlap(t):
    parts = months(t, "archived", "true").select("month").distinct()
    return ob.archive_overlap(parts, START, END)


@query("freeze_manifest", sql("""
SELECT query_id, run_id, finished_at FROM run WHERE status = 'succeeded'
AND finished_at >= TIMESTAMP '1998-01-10 06:00' AND finished_at < TIMESTAMP '1998-06-20 18:00'"""))
def freeze_manifest(t):
    """Frozen once: asked again for another range, the stored manifest answers."""
    path = f"{work_dir(t.spark, 'manifest')}/frozen"
    ex.frozen_manifest(t.runs(), START, END, path, 1_000_000)
    return ex.frozen_manifest(t.runs(), datetime(1995, 1, 1), END, path, 1)


@query("manifest_overflow", sql("""
SELECT query_id, count(*) AS runs FROM run WHERE status = 'succeeded' AND finished_at >= TIMESTAMP '1998-01-10 06:00'
AND finished_at < TIMESTAMP '1998-06-20 18:00' GROUP BY 1 HAVING count(*) > 8"""))
def manifest_overflow(t):
    return ex.manifest_overflow(ex.freeze_manifest(t.runs(), START, END), 8)


@query("missing_months", sql("""
SELECT DISTINCT date_trunc('month', finished_at)::DATE AS month FROM run WHERE status = 'succeeded'
  AND finished_at >= TIMESTAMP '1998-01-10 06:00' AND finished_at < TIMESTAMP '1998-06-20 18:00'
  AND month(finished_at) IN (2, 3, 5)"""))
def missing_months(t):
    manifest = ex.freeze_manifest(t.runs(), START, END)
    held = t.runs().where("finished_at IS NOT NULL").select(ob.month_of(F.col("finished_at")).alias("month")).distinct()
    hot = held.where("month(month) = 4")
    archived = held.where("month(month) = 1")
    return ob.missing_source_months(manifest, t.runs(), hot, archived, date(1998, 6, 20))


def exported(t):
    observations = wr.mark_lowest(t.observations(START, END))
    in_range = observations.where((F.col("observed_at") >= F.lit(START).cast("timestamp_ntz"))
                                  & (F.col("observed_at") < F.lit(END).cast("timestamp_ntz")))
    manifest = ex.freeze_manifest(t.runs(), START, END)
    return ex.export_rows(in_range, manifest, contexts(t), t.legs(), datetime(1998, 7, 1))


@query("export_csv", sql(f"""
SELECT '1' AS schema_version, 'canonical_query' AS scope, subscription_id::VARCHAR AS subscription_id,
  o.query_id::VARCHAR AS search_query_id, provider, trip_type, a.origin, a.destination,
  a.departure_date::VARCHAR AS departure_date, b.departure_date::VARCHAR AS return_date,
  '1998-07-01T00:00:00.000000Z' AS snapshot_at, obs_id AS observation_id,
  strftime(observed_at, '%Y-%m-%dT%H:%M:%S.000000Z') AS observed_at, run_id::VARCHAR AS collection_run_id, itinerary_id,
  offer_id AS fare_offer_id, offer_fingerprint, o.currency, total_price_minor::VARCHAR AS total_price_minor,
  CASE WHEN is_lowest THEN 'True' ELSE 'False' END AS is_lowest, CASE WHEN is_direct THEN 'True' ELSE 'False' END AS is_direct
FROM obs o JOIN context c USING (query_id) JOIN leg a ON a.query_id = o.query_id AND a.position = 0
LEFT JOIN leg b ON b.query_id = o.query_id AND b.position = 1 WHERE {_RANGE}"""))
def export_csv(t):
    """The written files are read back."""
    path = work_dir(t.spark, "csv")
    ex.export_csv(exported(t), path)
    return ex.read_export(t.spark, path)


@query("export_json", sql(f"""
SELECT run_id AS collection_run_id, currency, offer_id AS fare_offer_id, is_direct, is_lowest, itinerary_id,
  obs_id AS observation_id, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.000000Z') AS observed_at, offer_fingerprint,
  total_price_minor FROM obs JOIN sub USING (query_id) WHERE {_RANGE}"""))
def export_json(t):
    path = work_dir(t.spark, "json")
    ex.export_json(exported(t), path, {"schema_version": 1, "scope": "canonical_query"})
    schema = ("collection_run_id LONG, currency STRING, fare_offer_id STRING, is_direct BOOLEAN, is_lowest BOOLEAN, "
              "itinerary_id STRING, observation_id STRING, observed_at STRING, offer_fingerprint STRING, "
              "total_price_minor LONG")
    return t.spark.read.schema(schema).json(f"{path}/observations")


@query("export_summary", sql(f"""
SELECT search_query_id, count(*) AS row_count, sum(strlen(line) + 1)::BIGINT AS byte_count FROM (
  SELECT o.query_id AS search_query_id, concat_ws(',', o.currency, obs_id, total_price_minor, o.query_id) AS line
  FROM obs o WHERE {_RANGE}) GROUP BY 1"""))
def export_summary(t):
    rows = t.observations(START, END).where((F.col("observed_at") >= F.lit(START).cast("timestamp_ntz"))
                                            & (F.col("observed_at") < F.lit(END).cast("timestamp_ntz")))
    narrow = rows.select("currency", F.col("obs_id").alias("observation_id"), F.col("query_id").alias("search_query_id"),
                         "total_price_minor")
    return ex.export_summary(narrow, "search_query_id").drop("checksum")


@query("append_new", sql(f"SELECT {_OBS_OUT} FROM obs"))
def append_new(t):
    """A repeated batch that overlaps the table adds only the rows that are new."""
    rows = t.observations().select("obs_id", "observed_at", "query_id", "run_id", "currency", "total_price_minor")
    cut = F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz")
    target = rows.where(F.col("observed_at") < cut)
    overlap = rows.where(F.col("observed_at") >= F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz"))
    batch = overlap.unionByName(overlap)
    return target.unionByName(wr.append_new(target, batch, ["observed_at", "run_id", "obs_id"]))


@query("missing_hot_months", sql("""
SELECT m::DATE AS month FROM (SELECT unnest(generate_series(DATE '1994-11-01', DATE '1996-01-01', INTERVAL 1 MONTH)) AS m)
WHERE m NOT IN (SELECT date_trunc('month', finished_at) FROM run WHERE finished_at IS NOT NULL)"""))
def missing_hot_months(t):
    hot = t.runs().where("finished_at IS NOT NULL").select(ob.month_of(F.col("finished_at")).alias("month")).distinct()
    return ob.require_complete_months(hot, date(1994, 11, 20), date(1996, 1, 5))
