from __future__ import annotations

import itertools
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyledger.llm import queries, windows

from .conftest import collected, documents, prose

WORD = queries.vocabulary("word_bpe_49k.json")


def test_combinations_are_all_there():
    want = {
        tuple(sorted(c, reverse=True)) for k in (1, 2, 3) for c in itertools.product(range(1, 13), repeat=k) if sum(c) == 12
    }
    assert sorted(windows.combinations(12, 3)) == sorted(want)


def test_least_squares_are_optimal():
    rng = np.random.default_rng(1)
    for rows, columns in ((5, 3), (20, 60), (64, 200)):
        a, b = rng.random((rows, columns)) * (rng.random((rows, columns)) < 0.3), rng.random(rows) * 50
        x = windows.nnls(a, b)
        slope = a.T @ (b - a @ x)
        # No direction that keeps x non-negative lowers the error.
        assert (x >= 0).all() and slope.max() <= 1e-6 * 50 and np.abs(slope[x > 0]).max(initial=0) <= 1e-6 * 50


def placed(lengths, pieces, capacity=4096):
    """Fills of the sequences, after all ids were found at their places once."""
    spans, sequences = defaultdict(list), defaultdict(list)
    for item, start, length, sequence, offset in zip(*(x.tolist() for x in pieces)):
        assert length > 0
        spans[item].append((start, length))
        sequences[sequence].append((offset, length))
    assert set(spans) == set(range(len(lengths)))
    for parts, whole in [*((p, lengths[k]) for k, p in spans.items()), *((p, None) for p in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= capacity and whole in (None, at)
    return [sum(n for _, n in p) for p in sequences.values()]


@pytest.mark.parametrize("kind", ["short", "long", "even", "same", "tiny", "one", "hot"])
def test_nothing_is_padded(kind):
    rng = np.random.default_rng(2)
    lengths = {
        "short": np.clip(rng.lognormal(5, 1, 6000), 1, 4095), "long": np.clip(rng.lognormal(7.5, 1, 3000), 1, 4095),
        "even": rng.integers(1, 4096, 3000), "same": np.full(2000, 1500), "tiny": np.full(9000, 3), "one": np.array([4095]),
        "hot": np.concatenate([np.full(1500, 2049), rng.integers(1, 4096, 1500)]),
    }[kind].astype(int)
    steps = windows.plan(Counter(lengths.tolist()))
    pieces = windows.pack_cell(lengths, steps)
    fills = placed(lengths, pieces)
    assert all(n & (n - 1) == 0 for n in fills)
    short = [n for n in fills if n < 4096]
    assert sum(short) < 4096 and len(short) == len(set(short))
    # At most about one cut for each sequence.
    assert len(pieces[0]) <= len(lengths) + 1.02 * len(fills) + 13


def test_plan_repeats_what_the_histogram_holds():
    rng = np.random.default_rng(3)
    histogram = Counter(rng.integers(1, 200, 40_000).tolist())
    items = sum(histogram.values())
    used = Counter()
    for window, ways in windows.plan(histogram):
        for way, share in ways:
            assert sum(way) == windows.UNITS and len(way) <= windows.DEPTH
            if window == windows.UNITS:
                used.update({part: share * items * way.count(part) for part in set(way)})
    assert all(count <= histogram[part] + 1e-6 for part, count in used.items())
    assert sum(used.values()) > 0.8 * sum(histogram[k] for k in range(1, 65))


def test_no_items():
    assert windows.plan({}) == []


def check(df, **options):
    library, want = pytest.importorskip("tokenizers").Tokenizer.from_file(WORD), []
    for doc_id, text in collected(df, "doc_id", "text"):
        want.append((doc_id, [*library.encode(text or "", add_special_tokens=False).ids, 2]))
    got = windows.packed_documents(df, WORD, end=2, drops_space=True, **options).collect()
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in got:
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= options.get("capacity", 4096)
    wanted = defaultdict(list)
    for doc_id, ids in want:
        wanted[doc_id, len(ids)].append(ids)
    assert set(by_doc) == set(wanted)
    for key, parts in by_doc.items():
        if len(wanted[key]) == 1:
            assert [x for _, p in sorted(parts) for x in p] == wanted[key][0]
        else:
            # Equal rows: every id of every one of them is there once.
            assert Counter(s + k for s, p in parts for k in range(len(p))) == {k: len(wanted[key]) for k in range(key[1])}
            assert {(s + k, x) for s, p in parts for k, x in enumerate(p)} == {(k, x) for w in wanted[key] for k, x in enumerate(w)}
    return len(sequences)


def test_documents_are_packed(spark, awkward):
    check(awkward)
    check(awkward, capacity=256, cell_items=4)


def test_many_documents(spark):
    rows = [(k, prose(k, 5 + 37 * k % 900), "en", "a") for k in range(300)]
    check(documents(spark, rows), cell_items=64)


def test_no_documents(spark, nothing):
    assert windows.packed_documents(nothing, WORD, end=2, drops_space=True).count() == 0


def test_capacity_must_be_a_power_of_two(spark, nothing):
    with pytest.raises(ValueError, match="power of two"):
        windows.packed_documents(nothing, WORD, end=2, drops_space=True, capacity=1000)


def test_digests_of_the_query(spark):
    rows = queries.QUERIES["op13_window_packing"](spark, "/root/testdata/sf0.001").limit(20).collect()
    assert all(0 <= r["ids_crc32"] < 1 << 32 and r["length"] <= r["doc_tokens"] for r in rows)
    assert zlib.crc32(b"") == 0
