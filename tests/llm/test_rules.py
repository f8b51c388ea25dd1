from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyledger.llm import common, rules

from .conftest import collected, documents, prose


def measures(text):
    text = text or ""
    words = re.findall(common.WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(common.WORD, x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(rules.SYMBOLS, text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures(spark, awkward):
    texts = [
        "a b c", "a b c a b c", "a a a a", "a b a b a b a", "x", "\n\n", "a\na\n a\nb\n", "# $$ |\n# $$ |", None, "", "\r\n\x0b",
        prose(1, 60) + "\n" + prose(1, 60), "é é é é", "　 　 　 　", " ".join("abcab" * 2000), prose(2, 30_000),
    ]
    df = documents(spark, list(enumerate(texts)))
    got = {r[0]: r[1:] for r in collected(rules.measured(df), "doc_id", *COLUMNS)}
    assert got == {k: measures(t) for k, t in enumerate(texts)}
    rows = collected(rules.measured(awkward), "doc_id", *COLUMNS)
    assert sorted(rows, key=repr) == sorted(((d, *measures(t)) for d, t in collected(awkward, "doc_id", "text")), key=repr)


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 50, 400) for k in (0, 1, n // 20, n // 3, n) for p in (0.02, 0.05, 0.3)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for p in (0.02, 0.05, 0.3):
        for k, n, tail in df.distinct().select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), p)).collect():
            want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert tail == pytest.approx(want, rel=1e-9, abs=1e-12)
    big = spark.createDataFrame([(900, 1_000_000)], "k long, n long").select(rules.binomial_tail(F.col("k"), F.col("n"), 0.001)).first()[0]
    assert 0.0 < big < 0.01


def test_cutoffs_keep_the_risk(spark):
    # In stratum a, 1 % of good texts have a share above 0.1; in b, all have.
    rows = [("a", 0.15 if k % 100 == 0 else 0.0) for k in range(3000)] + [("b", 0.15)] * 3000 + [("few", 0.0)] * 20
    df = spark.createDataFrame(rows, "stratum string, symbol_share double")
    for rule in rules.RULES:
        if rule != "symbol_share":
            df = df.withColumn(rule, F.lit(0.0))
    got = {(s, r): c for s, r, c in collected(rules.cutoffs(df), "stratum", "rule", "cutoff")}
    assert got["a", "symbol_share"] == 0.01 and got["b", "symbol_share"] == 0.2
    assert not any(s == "few" for s, _ in got)
    strict = {(s, r): c for s, r, c in collected(rules.cutoffs(df, risk=0.005), "stratum", "rule", "cutoff")}
    assert strict["a", "symbol_share"] == 0.2


def test_all_rules_together_keep_the_risk(spark):
    # Each rule's strictest cutoff rejects other good documents: 3 % each, 15 % together.
    names = list(rules.RULES)
    rows = [("a", *[100.0 if k % 100 // 3 == i else 0.0 for i in range(5)]) for k in range(5000)]
    rows += [("b", *[0.0] * 5)] * 1000
    holdout = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{n} double" for n in names))
    got = {(s, r): c for s, r, c in collected(rules.cutoffs(holdout), "stratum", "rule", "cutoff")}
    hit = sum(any(x > got.get((r[0], n), 1e9) for n, x in zip(names, r[1:])) for r in rows if r[0] == "a")
    assert 0 < hit <= 0.05 * 5000
    assert {r: c for (s, r), c in got.items() if s == "b"} == {n: min(rules.CUTOFFS[n]) for n in names}


def test_verdicts(spark, awkward, nothing):
    good = [(k, prose(k, 80), "en", "a") for k in range(400)]
    bad = [(1000 + k, prose(k, 80).replace(" ", " %%% "), "en", "a") for k in range(20)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(k, 1, "x") for k in range(400)] + [(1000, 0, "x"), (None, 1, "x"), (7, None, "x")], "doc_id long, quality int, kept string")
    kept = dict(collected(rules.judged(docs, labels), "doc_id", "kept"))
    assert not any(kept[1000 + k] for k in range(20)) and sum(kept[k] for k in range(400)) >= 380
    # Without labels the base rules alone decide.
    alone = rules.judged(docs, labels.limit(0))
    assert alone.where("kept = base_failed").count() == 0
    assert rules.judged(awkward, labels).count() == awkward.count() and rules.judged(nothing, labels).count() == 0


def test_no_python_in_the_plan(spark, awkward):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = rules.measured(awkward)._jdf.queryExecution().toString() + rules.judged(awkward, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
