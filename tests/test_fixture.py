from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.operators import filters as fl
from skyledger.operators import latest as la
from skyledger.operators import trends as tr
from skyledger.operators.history import time_range
from skyledger.sources.fixture import PROFILES, Load

ANCHOR = datetime(2026, 5, 1, 12)


@pytest.fixture(scope="module")
def load(spark):
    return Load.of(spark, "smoke", ANCHOR, days=20)


def test_tables_have_the_size_of_their_profile(load):
    users, per_user, queries, per_query = PROFILES["smoke"]
    assert load.queries().count() == queries
    assert load.subscriptions().count() == load.filters().count() == load.alert_rules().count() == users * per_user
    succeeded = load.runs().where("status = 'succeeded'")
    lost = load.runs().count() - succeeded.count()
    rows = load.observations().count()
    assert queries * per_query - 5 * lost <= rows <= queries * per_query and lost > 0
    assert load.offers().count() == load.itineraries().count() == rows
    assert load.calendar_observations().count() == 30 * queries


def test_rows_refer_to_each_other(load):
    for child, parent, key in (
        (load.observations(), load.itineraries(), "itinerary_id"), (load.segments(), load.itineraries(), "itinerary_id"),
        (load.itineraries(), load.segments(), "itinerary_id"), (load.offers(), load.runs().where("status = 'succeeded'"), "run_id"),
        (load.runs(), load.queries(), "query_id"), (load.subscriptions(), load.queries(), "query_id"),
        (load.legs(), load.queries(), "query_id"), (load.alert_rules(), load.subscriptions(), "subscription_id"),
        (load.calendar_observations(), load.runs(), "run_id"),
    ):
        assert child.join(parent, key, "left_anti").count() == 0
    for table, key in ((load.runs(), "run_id"), (load.itineraries(), "itinerary_id"), (load.observations(), "obs_id")):
        assert table.select(key).distinct().count() == table.count()
    flown = load.segments().groupBy("itinerary_id").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))
    wrong = flown.join(load.itineraries(), "itinerary_id").where("n <> leg_count * (stop_count + 1) OR last <> n - 1")
    assert wrong.count() == 0
    ends = load.segments().join(load.legs().withColumnRenamed("position", "leg_position").select(
        "query_id", "leg_position", F.col("origin").alias("o"), F.col("destination").alias("d")), ["query_id", "leg_position"])
    per_leg = ends.groupBy("itinerary_id", "leg_position").agg(
        F.min_by("origin", "position").alias("first"), F.max_by("destination", "position").alias("last"), F.max("o").alias("o"), F.max("d").alias("d"))
    assert per_leg.where("first <> o OR last <> d").count() == 0


def test_every_read_gives_the_same_rows(spark, load):
    again = Load.of(spark, "smoke", ANCHOR, days=20)
    mark = F.bit_xor(F.xxhash64("obs_id", "observed_at", "total_price_minor", "is_direct"))
    assert load.observations().agg(mark).first() == again.observations().repartition(7).agg(mark).first()


def test_maintained_trend_equals_raw_on_the_load(load, plain):
    rows = fl.contexts(load.subscriptions(), load.queries(), load.filters())
    since = ANCHOR - timedelta(days=10)
    window = time_range(load.observations(), since.replace(hour=0), ANCHOR)
    features = fl.itinerary_features(load.itineraries(), load.segments())
    branches = fl.branches(rows)
    days = tr.tracked_days(load.subscriptions().where("query_id % 3 > 0"), since.date(), ANCHOR.date())
    points = tr.trend_contributions(
        window, features, branches, tr.daily_trend(window), tr.trend_coverage(days, window), since, ANCHOR)
    want = tr.raw_contributions(window, features, branches, since, ANCHOR)
    assert want.count() > 0
    assert plain(tr.route_trend(points, rows)) == plain(tr.route_trend(want, rows))


def test_latest_fares_on_the_load(load):
    rows = fl.contexts(load.subscriptions(), load.queries(), load.filters())
    branches = fl.branches(rows)
    passing = la.passing_latest(
        load.offers(), load.runs(),
        lambda kept: fl.itinerary_features(la.only_itineraries(load.itineraries(), kept), la.only_itineraries(load.segments(), kept)),
        branches)
    fares = la.latest_fares(passing, rows)
    newest = load.runs().where("status = 'succeeded'").groupBy("query_id").agg(F.max("finished_at").alias("t"))
    told = fares.join(load.subscriptions().select("subscription_id", "query_id"), "subscription_id").join(newest, "query_id")
    assert told.count() > 0 and told.where("observed_at <> t").count() == 0
