from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import common, queries, tokens

from .conftest import collected, prose

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
ODD = [
    "", " ", "  a  b", "a \n b\n", "\n\n x  ", "x<|endoftext|> y", "a<|startoftext|>b", "don't DON'T 'll |'s", "Σας ΣΑΣ", "éa É .́",
    "Ä×÷ß ª µ", "1½2 a1b2 3.4,5", "\x0b\x0c a\x1cb", "a b c  d　 \n　x", "İI ı K Å", "…., “a” .“", "<|", "a_b _c 5_6", "\n",
]


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_ids_are_those_of_the_library(path, drops):
    rng = random.Random(3)
    letters = "aB1.,|'<é×ß \n\t ́Σ%$½x"
    texts = [*ODD, *("".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)), prose(1, 3000)]
    mine = tokens.CachedTokenizer(path, drops)
    library = tokenizers.Tokenizer.from_file(path)
    for some in (texts, texts[:40], texts[::-1]):
        for text, ids in zip(some, mine.encode_all(pa.array(some), 7)):
            assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 7], text


def test_small_memory_of_spans_changes_nothing(monkeypatch):
    texts = [prose(k, 200) for k in range(20)]
    whole = [x.tolist() for x in tokens.CachedTokenizer(BYTE, False).encode_all(pa.array(texts))]
    monkeypatch.setattr(tokens, "CACHE_SPANS", 50)
    monkeypatch.setattr(common, "CHUNK", 1000)
    small = tokens.CachedTokenizer(BYTE, False)
    assert [x.tolist() for t in texts for x in small.encode_all(pa.array([t]))] == whole


def test_words_hold_what_was_packed():
    rng = np.random.default_rng(4)
    for ids in (
        np.zeros(0, np.uint32), np.zeros(500, np.uint32), np.ones(61, np.uint32), np.array([(1 << 28) - 1, 0, 1 << 20], np.uint32),
        rng.integers(0, 1 << 28, 1000).astype(np.uint32), rng.integers(0, 1 << 32, 1000).astype(np.uint32),
        np.array([(1 << 32) - 1, 1 << 30, 5, (1 << 30) - 1, 1 << 31], np.uint32), (rng.integers(0, 1 << 28, 5000) >> rng.integers(0, 28, 5000)).astype(np.uint32),
    ):
        words = tokens.pack(ids)
        assert (tokens.unpack(words, len(ids)) == ids).all()
    assert len(tokens.pack(rng.integers(0, 1 << 15, 4000).astype(np.uint32))) <= 1010
    # What no selector has room for takes an escape.
    words = tokens.pack(np.array([1, 1 << 30, 2], np.uint32))
    assert tokens.ESCAPE in (words >> np.uint64(60)).tolist()
    with pytest.raises(ValueError, match="2\\^32"):
        tokens.pack(np.array([1 << 32], np.uint64))


@pytest.mark.parametrize(("file_bytes", "block_ids"), [(1, 1), (2000, 300), (1 << 24, 1 << 16)])
def test_files_hold_all_documents_in_order(spark, awkward, file_bytes, block_ids):
    folder = common.shared_dir(spark, "t-ids")
    manifest = tokens.write_ids(awkward, folder, WORD, end=2, drops_space=True, shard_bytes=3000, file_bytes=file_bytes, block_ids=block_ids)
    got = collected(tokens.read_ids(manifest, folder), "doc_id", "start", "n_tokens", "ids_crc32")
    library, start, want = tokenizers.Tokenizer.from_file(WORD), 0, []
    rows = collected(awkward, "doc_id", "text")
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_no_documents(spark, nothing):
    folder = common.shared_dir(spark, "t-ids")
    assert tokens.read_ids(tokens.write_ids(nothing, folder, WORD, end=2, drops_space=True), folder).count() == 0
