"""Plans that must keep their shape: pruning, pushdown, bounded groups."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skyledger.operators import paging, trends
from skyledger.sources.testdata import FareTables

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_cut_groups_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS g", "id AS k")
    paged = paging.first_pages(rows, ["g"], ["k"], 10)
    text = plan(paged)
    assert text.count("WindowGroupLimit") == 2
    assert "Partial" in text
    assert paged.count() == 30
    assert [r.has_more for r in paged.select("has_more").distinct().collect()] == [True]


def test_pages_after_a_cursor(spark, plain):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "p int, i string")
    up = paging.page(rows, ["p", "i"], 2, (1, "b"))
    assert plain(up, "p", "i", "has_more") == [(2, "a", True), (2, "b", True)]
    down = paging.page(rows, ["p", "i"], 2, (2, "a"), descending=True)
    assert plain(down, "p", "i", "has_more") == [(1, "a", False), (1, "b", False)]
    with pytest.raises(ValueError):
        paging.page(rows, ["p"], 501)


@needs_data
def test_time_bounds_and_columns_reach_the_scan(spark):
    tables = FareTables(spark, FOLDER)
    daily = trends.daily_trend(tables.observations(datetime(1998, 1, 1, 6), datetime(1998, 2, 1)))
    text = plan(daily)
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00" in text
    assert "LessThanOrEqual(o_orderdate,1998-02-01T00:00" in text
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    assert scans and not any("l_tax" in line or "o_totalprice" in line for line in scans)


@needs_data
def test_daily_rows_need_two_shuffles_after_the_join(spark):
    daily = trends.daily_trend(FareTables(spark, FOLDER).observations())
    assert plan(daily).count("Exchange hashpartitioning") == 2


def test_no_cross_join_and_no_row_python(spark):
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "skyledger"
    text = "\n".join(p.read_text() for p in root.rglob("*.py"))
    for word in ("crossJoin", "localCheckpoint", "toPandas", "F.udf(", ".rdd"):
        assert word not in text
    assert F is not None


def test_rules_are_evaluated_once_for_their_events(spark, monkeypatch):
    import catalog.alerts as ca
    from skyledger.sources.testdata import FareTables

    calls = []
    real = ca.evaluated
    monkeypatch.setattr(ca, "evaluated", lambda t: calls.append(1) or real(t))
    ca.events(FareTables(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1


def test_days_that_are_walked_are_told_without_a_join(spark, plain):
    """Rows of the days of asked runs and of the first days of their look-backs are shuffled once."""
    from skyledger.operators import alerts as al

    best = spark.sql("""SELECT unhex('01') AS branch_key, * FROM VALUES (1L, TIMESTAMP_NTZ'2026-01-01 08:00:00', 10L, true),
      (2L, TIMESTAMP_NTZ'2026-01-01 09:00:00', 12L, true), (3L, TIMESTAMP_NTZ'2026-01-03 10:00:00', 11L, true),
      (4L, TIMESTAMP_NTZ'2026-01-03 11:00:00', 9L, true) AS t(run_id, observed_at, price_minor, is_direct)""")
    windows = spark.sql("SELECT unhex('01') AS branch_key, * FROM VALUES (cast(null AS bigint)), (2L) AS t(window_days)")
    asked = spark.sql("SELECT * FROM VALUES (2L), (4L) AS t(run_id)")
    rows = al.previous_minimum(best, windows, asked)
    assert plain(rows, "window_days", "run_id", "previous_minimum") == sorted(
        [(None, 2, 10), (None, 4, 10), (2, 2, 10), (2, 4, 11)], key=repr)
    assert "LeftSemi" not in rows._jdf.queryExecution().optimizedPlan().toString()
