from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from skyledger.llm import packing, queries

from .conftest import collected

BYTE = queries.vocabulary("byte_bpe_50k.json")


def bins_of(rows):
    found = defaultdict(list)
    for length, sequence, offset in rows:
        found[sequence].append((offset, length))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(found)


def test_documents_are_cut_and_packed(spark, awkward):
    tokenizers = pytest.importorskip("tokenizers")
    library, want = tokenizers.Tokenizer.from_file(BYTE), []
    for doc_id, text in collected(awkward, "doc_id", "text"):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)] if len(ids) > first else [0]
        for piece, start in enumerate(starts):
            part = ids[start : (starts[piece + 1] if piece + 1 < len(starts) else len(ids))]
            want.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.packed_documents(awkward, BYTE, end=2, drops_space=False)
    rows = [tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    assert sorted((r[:5] for r in rows), key=repr) == sorted(want, key=repr)
    bins_of([(r[3], r[5], r[6]) for r in rows])


def test_no_documents(spark, nothing):
    assert packing.packed_documents(nothing, BYTE, end=2, drops_space=False).count() == 0


def test_items_keep_their_places_and_bins_are_few(spark):
    rng = np.random.default_rng(1)
    lengths = [*rng.integers(1, 1025, 3000).tolist(), *([1024] * 20), *([512] * 50), 1, 1]
    df = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = {r[0]: r[1:] for r in collected(packing.pack(df, cell_items=500), "item", "sequence_id", "offset")}
    assert set(got) == set(range(len(lengths)))
    count = bins_of([(n, *got[k]) for k, n in enumerate(lengths)])
    assert count <= 1.02 * -(-sum(lengths) // 1024) + 8


def test_bad_lengths_fail(spark):
    with pytest.raises(Exception, match="length out of range"):
        packing.pack(spark.createDataFrame([(1, 1025)], "item long, length long")).collect()


def test_a_child_holds_every_item_once_and_fits():
    rng = np.random.default_rng(2)
    lengths = rng.integers(200, 700, 300)
    a, b = (packing.best_fit(lengths, rng.permutation(300), 1024) for _ in range(2))
    for _ in range(30):
        child = packing.cross(a, b, lengths, 1024, rng)
        assert len(child) == 300 and np.bincount(child, weights=lengths).max() <= 1024 and set(child) == set(range(child.max() + 1))
        a, b = b, child


def test_evolution_beats_a_bad_start():
    rng = np.random.default_rng(3)
    # Triples of exactly full bins: best fit alone leaves gaps.
    parts = []
    for _ in range(60):
        x, y = rng.integers(260, 400), rng.integers(260, 400)
        parts += [x, y, 1024 - x - y]
    lengths = np.array(parts)
    plain = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 1024).max() + 1
    best = packing.evolve(lengths, 1024, 1, [], population=8, generations=200)[0]
    assert best.max() + 1 <= plain and np.bincount(best, weights=lengths).max() <= 1024
