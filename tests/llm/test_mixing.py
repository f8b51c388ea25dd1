from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import mixing

from .conftest import collected, documents, prose


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Round by round: what is above a cap goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        value = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if value[s] > most * sizes[s]]
        if not above:
            return fixed | value
        fixed |= {s: most * sizes[s] for s in above}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(900):
        source = ["hot", "hot", "hot", "ä", "z", "Z", None, "tiny"][int(rng.integers(0, 8))]
        rows.append((k, prose(k, int(rng.integers(1, 120) if source != "tiny" else 2)), "en", source))
    return documents(spark, [*rows, (1000, None, "en", "hot"), (1001, " ", None, None)])


def summed(df):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for source, size, source_size, goal, copies in collected(df, "source", "size", "source_size", "target", "copies"):
        sizes[source] += size
        taken[source] += copies * size
        target[source] = (source_size, goal)
        assert 0 <= copies <= 2
    return sizes, taken, target


@pytest.mark.parametrize("group", [40, 2048])
def test_sources_meet_their_targets(spark, corpus, group):
    mixed = mixing.mix(corpus, "doc_id", group=group).join(corpus.select("doc_id", "source"), "doc_id")
    sizes, taken, target = summed(mixed)
    want = targets(sizes)
    for source, (size, goal) in target.items():
        assert size == sizes[source] and goal == pytest.approx(want[source])
        assert abs(taken[source] - goal) <= 120
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_dominating_texts_are_made_up_for(spark):
    # More documents than a group holds: two texts have 40 % and 10 % of the words, another source has none like that.
    rows = [(k, prose(k, 30), "en", "a") for k in range(300)] + [(400, prose(400, 7000), "en", "a"), (401, prose(401, 1800), "en", "a")]
    rows += [(500 + k, prose(k, 20), "en", "b") for k in range(90)]
    df = documents(spark, rows)
    for seed in range(3):
        mixed = mixing.mix(df, "doc_id", group=40, seed=seed, weights=(1.0, 0.1)).join(df.select("doc_id", "source"), "doc_id")
        assert mixed.count() == len(rows)
        _, taken, target = summed(mixed)
        assert all(abs(taken[s] - goal) <= 30 for s, (_, goal) in target.items())


def test_reruns_agree_on_any_partitions(spark, corpus):
    def run(df):
        return sorted(collected(mixing.mix(df, "doc_id", group=50), "doc_id", "copies"))

    first = run(corpus)
    assert first == run(corpus.repartition(9)) == run(corpus.orderBy(F.desc("text")).coalesce(1))


def test_copies_keep_their_expectation(spark, corpus):
    small = corpus.where("source = 'Z' OR source = 'ä'").cache()
    total = defaultdict(float)
    for seed in range(12):
        for doc_id, copies in collected(mixing.mix(small, "doc_id", seed=seed), "doc_id", "copies"):
            total[doc_id] += copies / 12
    wanted = dict(collected(mixing.mix(small, "doc_id"), "doc_id", F.col("target") / F.col("source_size")))
    assert np.mean([total[d] - wanted[d] for d in wanted]) == pytest.approx(0, abs=0.06)


def test_awkward_rows(spark, awkward, nothing):
    got = mixing.mix(awkward, "doc_id")
    assert sorted(collected(got, "doc_id"), key=repr) == sorted(collected(awkward, "doc_id"), key=repr)
    assert got.where("size = 0 AND copies * size <> 0").count() == 0
    assert mixing.mix(nothing, "doc_id").count() == 0
    out = mixing.mixed(awkward)
    assert out.columns == awkward.columns and mixing.mixed(nothing).count() == 0
    words = out.agg(F.sum(mixing.word_count())).first()[0]
    assert words > 0


def test_only_empty_texts(spark):
    df = documents(spark, [(1, None, None, "a"), (2, "", None, None)])
    assert {r[1] for r in collected(mixing.mix(df, "doc_id"), "doc_id", "size")} == {0}
