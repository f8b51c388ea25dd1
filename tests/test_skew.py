"""Joins with a hot key, copies of rows, and missing keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyledger import skew
from skyledger.operators import writes


@pytest.fixture(scope="module")
def sides(spark):
    facts = spark.range(0, 6000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97).alias("k"),
        (F.col("id") % 5).alias("copy"))
    side = spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(
        spark.range(0, 3).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v")))
    return facts, side


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(sides, plain, how):
    facts, side = sides
    want = facts.join(side, ["k"], how)
    got = skew.salted_join(facts, side, ["k"], how, hot_keys=2, salts=5)
    assert got.columns == want.columns
    assert plain(got) == plain(want)


def test_hot_rows_are_spread(sides):
    facts, _ = sides
    salted = facts.where("k = 7").withColumn("s", skew.row_salt(facts.columns, 16))
    assert salted.select("s").distinct().count() > 8


def test_checked_join_takes_both_ways(sides, plain):
    facts, side = sides
    small = skew.join_checked(facts, side, ["k"], max_rows=1000)
    large = skew.join_checked(facts, side, ["k"], max_rows=10)
    assert "__salt" in large._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert plain(small) == plain(large)


def test_mark_lowest_marks_ties_of_a_hot_run(spark):
    obs = spark.range(0, 9000, 1, 4).selectExpr(
        "id AS obs_id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS run_id", "'CNY' AS currency", "id % 2 = 0 AS is_direct",
        "100 + id % 11 AS total_price_minor")
    marked = writes.mark_lowest(obs)
    assert marked.count() == 9000
    hot = marked.where("run_id = 1 AND is_lowest")
    assert hot.select("total_price_minor").distinct().collect()[0][0] == 100
    assert hot.count() == obs.where("run_id = 1 AND total_price_minor = 100").count()


def test_weights_are_counted_before_the_join(spark):
    """The pass that looks for hot keys reads the offers alone, not their join with the features."""
    from skyledger.operators import filters

    offers = spark.createDataFrame([("i1", 1, "CNY"), ("i2", 1, "CNY"), ("i3", 2, "CNY")],
                                   "itinerary_id string, query_id long, currency string")
    features = spark.createDataFrame([("i1", 0), ("i2", 1), ("i3", 2)], "itinerary_id string, stop_count int")
    branches = spark.createDataFrame([("b1", 1, "CNY"), ("b2", 1, "CNY"), ("b3", 2, "JPY")],
                                     "branch_key string, query_id long, currency string")
    rows = filters.with_branches(offers, features, branches, small=False)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # Facts with features, facts and branches with the hot keys, both salted: no second join with the features.
    assert plan.count("Join ") == 4
    assert sorted((r.itinerary_id, r.branch_key) for r in rows.collect()) == [
        ("i1", "b1"), ("i1", "b2"), ("i2", "b1"), ("i2", "b2")]


def test_rows_outside_a_range_are_dropped_before_their_shuffle(spark, tmp_path):
    """A shuffle join with a filtered side tests the other side's keys right behind its scan."""
    from skyledger.session import prepare_fares

    spark.range(1000).selectExpr("id AS run_id", "id % 100 AS day").write.parquet(str(tmp_path / "runs"))
    spark.range(5000).selectExpr("id % 1000 AS key", "id AS line").write.parquet(str(tmp_path / "lines"))
    prepare_fares(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = spark.read.parquet(str(tmp_path / "runs")).where("day < 3")
        joined = spark.read.parquet(str(tmp_path / "lines")).join(runs, F.col("key") == F.col("run_id"))
        assert "might_contain" in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count() == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
