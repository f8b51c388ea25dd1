from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import common, queries

from .conftest import collected
from .test_chosenpath import brute, shingles
from .test_mixing import targets
from .test_packing import bins_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before and after each stage."""
    docs = [common.table(spark, FOLDER, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(common.written(stage(spark, docs[-1], FOLDER), f"t-{name}"))
    return docs


def test_stages_keep_the_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_filters_only_drop(steps):
    for before, after in zip(steps[:3], steps[1:4]):
        assert after.exceptAll(before).count() == 0
        assert 0 < after.count() <= before.count()


def test_clean_documents_stay(spark, steps):
    labels = common.table(spark, FOLDER, "labels")
    clean = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    there = steps[0].join(clean, "doc_id").count()
    assert steps[2].join(clean, "doc_id").count() >= 0.95 * there
    bad = labels.where("quality = 0").select("doc_id")
    assert steps[2].join(bad, "doc_id").count() <= 0.2 * steps[0].join(bad, "doc_id").count()


def test_one_of_each_class_stays(steps):
    rows = collected(steps[2], "doc_id", "text")
    assert {d for (d,) in collected(steps[3], "doc_id")} == {c for _, c, _, _ in brute(rows)}
    assert all(n == 0 for *_, n in brute(collected(steps[3], "doc_id", "text")))


def test_the_mix_meets_its_targets(steps):
    def by_source(df):
        return {s: sum(len(re.findall(common.WORD, t)) for x, t in collected(df, "source", "text") if x == s) for s, in set(collected(df, "source"))}

    sizes, taken = by_source(steps[3]), by_source(steps[4])
    largest = max(len(re.findall(common.WORD, t)) for (t,) in collected(steps[3], "text"))
    for source, goal in targets(sizes).items():
        assert abs(taken.get(source, 0) - goal) <= largest
    assert steps[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_what_is_taken_is_packed(steps):
    rows = steps[5].collect()
    assert bins_of([(r["length"], r["sequence_id"], r["offset"]) for r in rows]) <= 1.1 * sum(r["length"] for r in rows) / 1024 + 2
    assert sum(r["piece"] == 0 for r in rows) == steps[4].count()


def test_stages_take_empty_tables(spark, steps):
    docs = common.written(steps[0].limit(0), "t-empty")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, FOLDER), "t-empty")
    assert docs.count() == 0


def test_stages_take_awkward_rows(spark, awkward):
    docs = common.written(awkward, "t-awkward")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, FOLDER), "t-awkward")
        if name != "packing":
            assert docs.columns == before.columns
    texts = [t for (t,) in collected(awkward, "text") if shingles(t)]
    assert docs.select("doc_id").distinct().count() <= len(texts)


def test_registered(spark):
    assert {re.match(r"op\d+|pipeline", q)[0] for q in queries.QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
