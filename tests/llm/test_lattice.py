from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import common, lattice, queries

from .conftest import collected, documents, prose

NAMES = sorted({bytes([b]) for b in range(256)} | {b" a", b" ab", b"ab", b"ba", b"aba", " é".encode(), "é".encode(), b"b" * 20})


@pytest.fixture(scope="module")
def pieces():
    weight = np.random.default_rng(1).uniform(0.5, 2, len(NAMES) + 1)
    return lattice.Pieces(NAMES, np.log(weight / weight.sum()))


def segmentations(word):
    if not word:
        yield ()
    for k, name in enumerate(NAMES):
        if word.startswith(name):
            for rest in segmentations(word[len(name) :]):
                yield (k, *rest)


def arrays(words):
    raw, offsets = common.text_buffers(pa.array(words))
    return raw, offsets[:-1], np.diff(offsets)


def test_every_segmentation_counts(pieces):
    words = ["a", "ab", "abab", "é", "xéab", "bababa", "☃", "b" * 25, "aba" * 4]
    logs = lattice.word_logs(pieces, *arrays(words))
    p = np.exp(pieces.logs)
    sums = np.zeros(len(p))
    for k, word in enumerate(words):
        ways = [(math.prod(p[i] for i in s), s) for s in segmentations(b" " + word.encode())]
        total = math.fsum(w for w, _ in ways)
        assert logs[k] == pytest.approx(math.log(total), rel=1e-9)
        for w, s in ways:
            for i in s:
                sums[i] += (k + 1) * w / total
    got = lattice.expected_pieces(pieces, *arrays(words), np.arange(1, len(words) + 1))
    assert got == pytest.approx(sums, rel=1e-6, abs=1e-9)


def test_long_words_take_the_other_way(pieces, monkeypatch):
    words = ["ab" * 30, "aéb" * 10, "b" * 70]
    one = lattice.expected_pieces(pieces, *arrays(words), np.ones(3)), lattice.word_logs(pieces, *arrays(words))
    monkeypatch.setattr(lattice, "LONG_WORD", 500)
    many = lattice.expected_pieces(pieces, *arrays(words), np.ones(3)), lattice.word_logs(pieces, *arrays(words))
    assert one[0] == pytest.approx(many[0], rel=1e-9) and one[1] == pytest.approx(many[1], rel=1e-9)


def test_estimation_never_lowers_the_likelihood(pieces):
    words, counts = ["ab", "aba", "abab", "baba", "é"], np.array([9, 5, 3, 2, 1])
    before = -np.inf
    here = pieces
    for _ in range(6):
        value = float((lattice.word_logs(here, *arrays(words)) * counts).sum())
        assert value >= before - 1e-9
        before = value
        sums = lattice.expected_pieces(here, *arrays(words), counts)
        here = lattice.Pieces(here.names, np.log(np.maximum(sums, 1e-12) / sums.sum()))


VOCABULARY = queries.vocabulary("piece_bpe_32k.model")


def plain(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(d, bool(t), [*re.findall(common.WORD, (x or "").translate(fold)), None]) for d, t, x in rows]
    count = Counter(w for _, t, ws in tokens if t for w in ws)
    total, kinds = sum(count.values()), len(count)
    return sorted(
        ((d, not t, len(ws), sum(count[w] > 0 for w in ws), total, round(math.fsum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), 5))
         for d, t, ws in tokens), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, awkward, small):
    pytest.importorskip("sentencepiece")
    df = awkward.selectExpr("*", "pmod(doc_id, 3) <> 1 AS train")
    more = documents(spark, [(100 + k, prose(k, 50).upper() if k % 2 else prose(k, 50)) for k in range(40)]).selectExpr("*", "doc_id % 3 <> 1 AS train")
    df = df.unionByName(more)
    got = lattice.scored(df, VOCABULARY, **({"block_words": 200, "range_bytes": 5000} if small else {})).cache()
    rows = collected(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert sorted(((*r[:5], round(r[5], 5)) for r in rows), key=repr) == plain(collected(df, "doc_id", "train", "text"))
    scores = {d: s for d, s in collected(got, "doc_id", "score")}
    assert all(np.isfinite(s) and s < 0 for s in scores.values())
    # A text of trained words is likelier than as many odd letters.
    assert scores[9] > -10 and scores[6] < -1000
    again = {d: s for d, s in collected(lattice.scored(df.repartition(5), VOCABULARY), "doc_id", "score")}
    assert again[100] == pytest.approx(scores[100], rel=1e-9)


def test_edge_tables(spark, nothing):
    pytest.importorskip("sentencepiece")
    assert lattice.scored(nothing.selectExpr("*", "true AS train"), VOCABULARY).count() == 0
    alone = lattice.scored(documents(spark, [(1, "ab"), (2, None)]).selectExpr("*", "false AS train"), VOCABULARY).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in alone} == {(0, 0, 0.0)}
