from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest

from skyledger.llm import zonemaps

from .conftest import collected

SCHEMA = "vec_id long, embedding array<float>, label int, row long, key int, packed string"


def vectors(spark, rows):
    return spark.createDataFrame([(name, v, 1, 7, 3, "x") for name, v in rows], SCHEMA)


def plain(rows, clusters=16, rounds=3, dimensions=64, scale=64):
    """The contract's rounds in plain integers."""
    kept = [
        (name, [int(x) for x in np.clip(np.floor(scale * np.asarray(v, np.float32).astype(float)), -zonemaps.LIMIT, zonemaps.LIMIT)])
        for name, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"1:{name}".encode()).hexdigest(), v) for name, v in kept if name is not None)
    centroids = [v for _, v in named + [("~", v) for name, v in sorted(kept, key=lambda r: r[1]) if name is None]][:clusters]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [
            [sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)
        ]
    found = [(name, *near(v)[::-1]) for name, v in kept]
    total = sum(r[2] for r in found)
    return sorted(
        (name, k, d, sum(r[2] for r in found if r[1] == k), total, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
        for name, k, d in found
    )


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_rounds_are_exact(spark, spread):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 0.5, (7, 64))
    rows = [(k, (middles[k % 7] + rng.normal(0, spread, 64)).tolist()) for k in range(900)]
    got = zonemaps.clustered(vectors(spark, rows), block=64)
    assert sorted(collected(got, *COLUMNS)) == plain(rows)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(k, rng.normal(0, 1, 64).tolist()) for k in range(40)]
    same = rng.normal(0, 1, 64).tolist()
    rows = [
        *good, *[(100 + k, same) for k in range(300)], (100, same), (100, same), (500, None), (501, []), (502, [0.5] * 63), (503, [0.5] * 65),
        (504, [None] + [0.5] * 63), (505, [float("nan")] + [0.5] * 63), (506, [float("inf")] * 64), (507, [0.0] * 64), (508, [-0.0] * 64),
    ]
    got = zonemaps.clustered(vectors(spark, rows), block=32)
    assert sorted(collected(got, *COLUMNS)) == plain(rows)


def test_huge_components_and_missing_names(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64), (4, [1.5] * 64)]
    got = zonemaps.clustered(vectors(spark, rows), clusters=3)
    most = (1 << 63) - 1
    assert sorted((*r[:3], min(r[3], most), min(r[4], most), r[5]) for r in plain(rows, clusters=3)) == sorted(collected(got, *COLUMNS))
    rows = [(None, [1.0] * 64), (None, [2.0] * 64), (9, [4.0] * 64)]
    got = collected(zonemaps.clustered(vectors(spark, rows), clusters=2), "vec_id", "cluster")
    assert sorted(got, key=repr) == [(9, 0), (None, 1), (None, 1)]


def test_no_vectors(spark):
    got = zonemaps.clustered(vectors(spark, [(1, [0.5] * 3)]).limit(0))
    assert got.count() == 0 and tuple(got.columns) == COLUMNS
    assert zonemaps.clustered(vectors(spark, [(1, [0.5] * 3)])).count() == 0


def test_curve_visits_every_cell_by_single_steps():
    for axes, bits in ((2, 3), (3, 2), (4, 2), (5, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = zonemaps.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_boxes_rule_out_only_centroids_that_are_never_nearest():
    rng = np.random.default_rng(5)
    few = 0
    for _ in range(200):
        low = rng.integers(-30, 30, 6)
        high = low + rng.integers(0, 12, 6)
        centroids = rng.integers(-40, 40, (10, 6))
        some = zonemaps.candidates(low, high, centroids)
        few += len(some)
        x = rng.integers(low, high + 1, (300, 6))
        apart = np.square(x[:, None, :] - centroids[None]).sum(axis=2)
        assert set(apart.argmin(axis=1).tolist()) <= set(some.tolist())
    assert few < 200 * 5


def test_blocks_of_clustered_vectors_have_few_candidates(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(0, 2, (16, 64))
    rows = [(k, (middles[k % 16] + rng.normal(0, 0.1, 64)).tolist()) for k in range(4000)]
    kept = zonemaps.whole_vectors(vectors(spark, rows)).selectExpr("*", "monotonically_increasing_id() AS row")
    zones = zonemaps.blocks(kept, block=128).collect()
    assert sum(len(z["vec_ids"]) for z in zones) == 4000 and max(len(z["vec_ids"]) for z in zones) == 128
    centroids = np.floor(64 * middles).astype(np.int64)
    counts = [len(zonemaps.candidates(np.array(z["low"], np.int64), np.array(z["high"], np.int64), centroids)) for z in zones]
    assert np.mean(counts) < 8 and np.median(counts) == 1
