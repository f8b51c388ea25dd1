from __future__ import annotations

import random

import pytest

from skyledger.llm import common

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, shard int, item int, "
    "copies int, junk string, found int, scores int, stratum int, row int"
)


@pytest.fixture(scope="session")
def spark(spark):  # noqa: F811 - the session of all tests, prepared for texts
    return common.prepared(spark)


def prose(seed: int, words: int, syllables=("an", "re", "ti", "on", "the", "al", "is", "er", "no", "vi")) -> str:
    """Invented words, in lines of ten."""
    rng = random.Random(seed)
    made = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + 10]) for i in range(0, words, 10))


def documents(spark, rows):
    """Rows ``doc_id, text`` (and lang, source) with other columns whose names operators use."""
    full = []
    for k, row in enumerate(rows):
        doc_id, text, lang, source = (*row, None, None)[:4] if len(row) < 4 else row
        full.append((doc_id, text, lang, source, None, "x", k % 2, None, k, 3, None, k, 1, 0, None))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, odd characters, clashing column names."""
    long_text = prose(1, 40_000)
    rows = [
        (1, prose(2, 300), "en", "a"), (1, prose(2, 300), "en", "a"), (2, None, None, None), (3, "", "en", "a"),
        (4, " \n\t ", "en", "b"), (None, prose(3, 120), "fr", None), (None, None, None, None), (5, long_text, "en", "a"),
        (6, "a" * 50_000, None, "b"), (7, "é ☃ \U0001f600 ﬁ Ǆ ß İ́ |x| <y> 1½", "fr", "b"), (8, prose(2, 300), "en", None),
        (9, "word", "en", "a"), (-5, prose(4, 80), "en", "c"), (1 << 40, prose(5, 60), "fr", "c"),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
