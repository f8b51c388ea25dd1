from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from skyledger.llm.prefixhash import PrefixHash, _points, fingerprints, likeness

from .conftest import collected, documents, prose


def hashed(text):
    return PrefixHash.of(_points(text))


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choices("ab☃", k=rng.randint(0, 40)))
        b = "".join(rng.choices("ab☃", k=rng.randint(0, 40)))
        x, y = hashed(a), hashed(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = rng.randint(0, 6)
        assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.common_extension(i, y, j) == k
        joined = x.joined(i, y, j)
        assert joined.whole() == hashed(a[:i] + b[:j]).whole()
        if joined.length >= 3:
            assert (joined.windows(3) == hashed(a[:i] + b[:j]).windows(3)).all()


def test_long_texts_do_not_overflow():
    text = "\U0010ffff" * 300_000 + "x"
    p = hashed(text)
    assert p.equal(0, p, 1, 299_000) and not p.equal(0, p, 2, 299_999) and p.common_extension(0, p, 5) == 299_995


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        same = [next((k for k, (a, b) in enumerate(zip(text, x)) if a != b), min(len(text), len(x))) for x in (edited, after)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *same))
    return out


@pytest.mark.parametrize("shard_bytes", [1, 2000, 1 << 22])
def test_every_row_meets_its_next(spark, awkward, shard_bytes):
    got = collected(fingerprints(awkward, shard_bytes=shard_bytes), "doc_id", "n_chars", "edited_sha256", "same_edited", "same_next")
    assert sorted(got, key=repr) == sorted(brute(collected(awkward, "doc_id", "text")), key=repr)


def test_fingerprints_tell_edits_from_strangers(spark):
    texts = [prose(k, 200) for k in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, texts[0]), (101, ""), (102, None), (103, "short"), (104, "short")]
    got = fingerprints(documents(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["fingerprint"] == by_id[100]["fingerprint"] != by_id[1]["fingerprint"]
    assert by_id[101]["fingerprint"] == by_id[102]["fingerprint"] and by_id[101]["near_next"] == 1.0
    assert by_id[103]["near_next"] == 1.0 and by_id[102]["near_next"] == 0.0
    for k in range(29):
        assert 0.5 < by_id[k]["near_edited"] < 0.95 and by_id[k]["near_next"] < 0.3
    # The edited text's fingerprint is that of the text itself.
    edited = [texts[k][: len(texts[k]) - len(texts[k]) // 4] + texts[k + 1][: len(texts[k]) // 4] for k in range(5)]
    again = fingerprints(documents(spark, list(enumerate(edited)))).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in again} == {k: by_id[k]["edited_fingerprint"] for k in range(5)}


def test_edge_tables(spark, nothing):
    assert fingerprints(nothing).count() == 0
    one = fingerprints(documents(spark, [(1, "abcdefgh")])).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert likeness(np.zeros(0, np.uint64), np.zeros(0, np.uint64)) == 1.0
