"""Registered queries against their SQL answers. CATALOG_ALL=1 runs all of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from catalog import check, registry

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
QUICK = (
    "history_day", "filter_all", "daily_trend", "trend_coverage", "latest_fares", "calendar_page", "price_snapshot",
    "collection_health", "due_by_query", "reuse_or_create_run", "deliverable", "rule_targets", "view_state",
    "classify_responses", "missing_months", "stream_latest_snapshot",
)
NAMES = sorted(registry.QUERIES) if os.environ.get("CATALOG_ALL") else QUICK

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    assert check.compare(df, entry.oracle_sql()[name], con) == []


def test_every_query_has_an_answer():
    assert set(registry.ORACLES) == set(registry.QUERIES)
