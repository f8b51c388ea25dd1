from __future__ import annotations

import random

import numpy as np
import pytest

from skyledger.llm import langid

from .conftest import collected, documents

SOUNDS = {
    "xa": ("ka", "mo", "ri", "tu", "ne"), "xb": ("sch", "ung", "ich", "ein", "ver"), "xc": ("ção", "lho", "nh", "ões", "ça"),
    "xd": ("κα", "το", "μη", "σε", "λι"),
}


def text(lang, words, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, text(lang, 60, k), lang, "a") for lang in SOUNDS for k in range(30)]
    rows += [(500, None, "xa", "a"), (501, "text without language", None, "a"), (502, "", "xb", "a"), (503, "123 %%", "xc", "a")]
    return langid.train(documents(spark, rows))


def test_languages_and_mixtures(spark, model):
    assert model.languages == sorted(SOUNDS)
    rows = [(k, text(lang, 40, 1000 + k), lang) for k, lang in enumerate(list(SOUNDS) * 5)]
    found = dict(collected(langid.identify(documents(spark, rows), model), "doc_id", "lang_pred"))
    assert found == {k: lang for k, _, lang in rows}
    mixed = text("xa", 120, 7) + " " + text("xd", 40, 8)
    row = langid.identify(documents(spark, [(1, mixed)]), model).first()
    assert row["lang_pred"] == "xa" and set(row["mixture"]) == {"xa", "xd"}
    letters = sum(map(len, text("xa", 120, 7).split())) / sum(map(len, mixed.split()))
    assert row["score"] == pytest.approx(letters, abs=0.08) and sum(row["mixture"].values()) == pytest.approx(1)


def test_proportions_are_the_likeliest(model):
    # Against a plain search over one proportion.
    mixed = text("xb", 30, 1) + " " + text("xc", 50, 2)
    _, gram, count = next(iter(langid.ngram_counts([mixed])))
    b, c = model.languages.index("xb"), model.languages.index("xc")
    p = np.exp(model.table[gram][:, [b, c]].astype(float))
    grid = np.linspace(0.01, 0.99, 99)
    best = grid[np.argmax([(count * np.log(p @ [t, 1 - t])).sum() for t in grid])]
    share = langid.proportions(model, [mixed], steps=60)[0]
    assert share[b] == pytest.approx(best, abs=0.015)


def test_production_defaults_reach_the_top(model):
    """Four languages, of shares near each other and far apart: no direction improves the likelihood, and all are found."""
    for words in ((40, 40, 40, 40), (200, 90, 40, 25), (55, 45, 3, 0)):
        mixed = " ".join(text(lang, n, 20 + n) for lang, n in zip(SOUNDS, words))
        share, fit = langid.mixtures(model, [mixed])
        _, gram, count = next(iter(langid.ngram_counts([mixed])))
        p = np.exp(model.table[gram].astype(float))
        # The top over all four, by many plain steps.
        theta = np.full(4, 0.25)
        for _ in range(20_000):
            part = p * theta
            theta = (part * (count / part.sum(axis=1))[:, None]).sum(axis=0) / count.sum()
        there = share[0] > 0
        assert {k for k, n in zip(SOUNDS, words) if n > 3} <= {model.languages[k] for k in np.flatnonzero(there)}
        if there.all():
            assert np.abs(share[0] - theta).max() < 0.01
        slope = (p[:, there] * (count / (p @ share[0]))[:, None]).sum(axis=0)
        assert slope.max() - count.sum() <= 2 * langid.SLACK
        assert fit[0] == pytest.approx((count * np.log(p @ share[0])).sum() / count.sum() + np.log(langid.BUCKETS)) and fit[0] > 0


def test_mixed_texts_stay_and_noise_goes(spark, model):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choices("bcdfgjkqwxzþđŋ", k=rng.randint(2, 9))) for _ in range(80))
    mixed = " ".join(text(lang, 40, 5) for lang in SOUNDS)
    rows = [(1, mixed), (2, noise), (3, text("xa", 40, 6)), (4, text("xa", 20, 6) + " " + text("xb", 20, 6)), (5, "12"), (6, None)]
    assert sorted(collected(langid.keep(documents(spark, rows), model), "doc_id")) == [(1,), (3,), (4,)]


def test_rows_without_letters_are_unknown(spark, model, awkward, nothing):
    rows = [(1, None), (2, ""), (3, "12 %% \U0001f600"), (4, "a")]
    got = {d: (p, s) for d, p, s in collected(langid.identify(documents(spark, rows), model), "doc_id", "lang_pred", "score")}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in SOUNDS
    out = langid.identify(awkward, model)
    assert out.count() == awkward.count() and out.columns.count("score") == 1
    assert all(0 <= s <= 1 for (s,) in collected(out, "score"))
    assert langid.identify(nothing, model).count() == 0
    assert langid.keep(awkward, model).columns == awkward.columns


def test_training_without_rows(spark, nothing):
    model = langid.train(nothing)
    assert model.languages == []
    assert collected(langid.identify(documents(spark, [(1, "some words")]), model), "lang_pred", "score") == [("und", 0.0)]


def test_batches_change_nothing(spark, model, monkeypatch):
    texts = [text(lang, 30 * (k % 4), k) for k, lang in enumerate(list(SOUNDS) * 6)]
    whole = langid.proportions(model, texts)
    monkeypatch.setattr(langid, "POINTS", 300)
    assert np.allclose(whole, langid.proportions(model, texts))


def test_held_out_documents(spark):
    from skyledger.llm import queries

    rows = queries.QUERIES["op2_language_mixture"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = collected(rows.where("held_out").join(docs, "doc_id"), "lang", "lang_pred")
    assert sum(a == b for a, b in got) >= 0.95 * len(got) > 0
