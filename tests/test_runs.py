"""Pages of runs: rows against a plain version, and what travels to make them."""

from __future__ import annotations

from datetime import datetime, timedelta

from skyledger.operators import paging, runs

START = datetime(2024, 1, 1)
# run, query, hours after the start, users that asked for it; a run may come twice.
RUNS = [(n, n % 3, n % 7, [n % 4] if n % 2 else []) for n in range(60)]
RUNS += [(70, 2, 9, [0, 0, None]), (70, 2, 9, [0]), (71, None, 8, [1]), (72, 0, None, [3])]
WATCHED = [(0, 0), (0, 0), (1, 0), (1, 1), (2, None), (4, 2)]


def tables(spark, tmp_path):
    rows = [(r, q, None if h is None else START + timedelta(hours=h), u, f"wide {r}") for r, q, h, u in RUNS]
    path = str(tmp_path / "runs")
    kind = "run_id long, query_id long, scheduled_at timestamp_ntz, on_demand_user_ids array<long>, wide string"
    spark.createDataFrame(rows, kind).write.parquet(path)
    return spark.read.parquet(path), spark.createDataFrame(WATCHED, "user_id long, query_id long")


def expected(limit: int, behind: dict | None = None):
    """Sorted (user, row, run, has_more) of every user's page."""
    pairs = {(u, q) for u, q in WATCHED if q is not None}
    seen = [(u, h, r) for r, q, h, _ in RUNS for u, w in pairs if w == q]
    seen += list({(u, h, r) for r, q, h, asked in RUNS for u in asked if (u, q) not in pairs})
    out = []
    for user in {u for u, _, _ in seen}:
        order = sorted(((-1 if h is None else h, r) for u, h, r in seen if u == user), reverse=True)
        if behind is not None:
            order = [x for x in order if user in behind and x < behind[user]]
        out += [(user, i, r, len(order) > limit) for i, (_, r) in enumerate(order[:limit], 1)]
    return sorted(out, key=repr)


def test_run_pages(spark, plain, tmp_path):
    rows, subscriptions = tables(spark, tmp_path)
    for limit in (1, 4, 30):
        got = runs.run_pages(rows, subscriptions, limit)
        assert plain(got, "user_id", "page_row", "run_id", "has_more") == expected(limit)
        assert {r.wide for r in got.collect()} == {f"wide {r[2]}" for r in expected(limit)}
    first = runs.run_pages(rows, subscriptions, 4)
    ends = paging.page_ends(first, ["user_id"], runs.RUN_ORDER, descending=True)
    hour = {r: -1 if h is None else h for r, _, h, _ in RUNS}
    behind = {u: (hour[r], r) for u, i, r, more in expected(4) if i == 4 and more and u is not None}
    second = runs.run_pages(rows, subscriptions, 4, ends)
    assert plain(second, "user_id", "page_row", "run_id", "has_more") == expected(4, behind)


def test_only_runs_of_pages_meet_the_users_whole(spark, tmp_path):
    rows, subscriptions = tables(spark, tmp_path)
    text = runs.run_pages(rows, subscriptions, 4)._jdf.queryExecution().optimizedPlan().toString()
    scans = sum("wide" in line for line in text.splitlines() if "Relation" in line)
    assert scans == text.count("LeftSemi") == 2
