from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import quality

from .conftest import collected, documents, prose

INSULTS = ("grobnik", "grobnat", "grobnul", "zurfal", "zurfek")


def insulting(seed):
    rng = random.Random(seed)
    words = prose(seed, 120).split()
    for _ in range(5):
        words.insert(rng.randint(0, len(words)), rng.choice(INSULTS))
    return " ".join(words)


def junk(seed):
    text = prose(seed, 100)
    return (text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), text.replace(" ", " | "), " ".join([text.split()[0]] * 90))[seed % 4]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, junk(k) if k % 6 == 0 else insulting(k) if k % 6 == 1 else prose(k, 110), "en", "a") for k in range(900)]
    labels = spark.createDataFrame(
        [(k, int(k % 6 != 0), int(k % 6 == 1), 1) for k in range(900) if (k // 12) % 2] + [(None, 1, 0, 1), (13, None, None, 1), (5000, 0, 1, 1)],
        "doc_id long, quality int, toxic int, kept int",
    )
    return documents(spark, rows), labels


def test_estimation_finds_the_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    votes = np.full((20_000, 4), -1)
    for k, (hit, false) in enumerate(((0.95, 0.02), (0.7, 0.1), (0.5, 0.01))):
        seen = rng.random(20_000) < 0.8
        bad = np.where(truth, rng.random(20_000) < hit, rng.random(20_000) < false)
        votes[:, k + 1] = np.where(seen, bad, -1)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality.estimate(patterns, counts.astype(float))[index.ravel()]
    assert ((posterior > 0.5) == truth).mean() > 0.93
    assert posterior[truth].mean() > 0.75 and posterior[~truth].mean() < 0.08


def test_weak_labels_find_what_nobody_labelled(spark, corpus):
    docs, labels = corpus
    got = {d: (j, t, k) for d, j, t, k in collected(quality.judged(docs, quality.train(docs, labels)), "doc_id", "junk", "toxic", "kept")}
    unseen = [k for k in got if not (k // 12) % 2]
    wrong = [k for k in unseen if got[k][2] != (k % 6 > 1)]
    assert len(wrong) <= 0.02 * len(unseen)
    assert all(got[k][0] > 0.5 for k in unseen if k % 6 == 0) and sum(got[k][1] > 0.5 for k in unseen if k % 6 == 1) > 70


def test_a_bounded_sample_does(spark, corpus):
    docs, labels = corpus
    model = quality.train(docs, labels, sample=300)
    got = dict(collected(quality.judged(docs, model), "doc_id", "kept"))
    assert sum(got[k] == (k % 6 > 1) for k in got) > 0.93 * len(got)


def test_measures_of_chunks_agree(monkeypatch):
    texts = pa.array([junk(k) for k in range(8)] + ["", "ÀÉ é", prose(1, 300)])
    low = pa.array([t.lower() for t in texts.to_pylist()])
    whole = list(quality.described(texts, low))
    monkeypatch.setattr(quality.common, "CHUNK", 200)
    parts = list(quality.described(texts, low))
    assert len(whole) == 1 and len(parts) > 3
    assert np.allclose(np.concatenate([d.m for d in parts]), whole[0].m)
    scorer = quality.Scorer(np.unique(whole[0].feats)[1:], np.arange(len(np.unique(whole[0].feats)) - 1) / 1e4)
    assert np.allclose(np.concatenate([scorer.odds(d) for d in parts]), scorer.odds(whole[0]))


def test_awkward_rows(spark, corpus, awkward, nothing):
    docs, labels = corpus
    model = quality.train(awkward.unionByName(docs), labels)
    out = quality.judged(awkward, model)
    assert out.count() == awkward.count() and [out.columns.count(c) for c in ("junk", "kept", "toxic")] == [1, 1, 1]
    for text, value, kept in collected(out, "text", "junk", "kept"):
        if not (text or "").strip():
            assert value == 1.0 and not kept
    assert quality.keep(awkward, model).columns == awkward.columns
    assert quality.judged(nothing, model).count() == 0


@pytest.mark.parametrize("which", ["labels", "documents", "both"])
def test_empty_tables(spark, corpus, nothing, which):
    docs, labels = corpus
    model = quality.train(nothing if which != "labels" else docs, labels if which == "documents" else labels.limit(0))
    rows = documents(spark, [(1, prose(1, 100)), (2, None)])
    assert dict(collected(quality.judged(rows, model), "doc_id", "kept")) == {1: True, 2: False}


def test_given_labels(spark):
    from skyledger.llm import queries

    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_quality_classifier"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = collected(got.select("doc_id", "kept").join(labels, "doc_id"), "kept", "quality", "toxic")
    clean = [k for k, q, t in rows if q == 1 and t == 0]
    bad = [k for k, q, t in rows if q == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(bad) <= 0.1 * len(bad)
