"""Probability of a text under a unigram model of subwords, over all segmentations.

The pieces are those of an existing vocabulary, whose scores rank them. A text is its words,
each with a space before it, and an end; every piece sequence that spells it is a
segmentation. No piece reaches over a space, so the marginal probability is the product of the
words' marginals, each a forward recursion in log space over the lattice of pieces.
Piece probabilities are re-estimated by expectation-maximisation over the lattices of all
different training words. Single bytes are pieces too, so every text has a probability.

Words are counted once per block of documents and travel as blocks of arrays: from blocks of
documents to ranges of word hashes, where counts and probabilities of each different word are
made, and back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

#: Words of a block of documents, and bytes of text per range of word hashes.
BLOCK_WORDS, RANGE_BYTES, LEAST_RANGES = 1_000_000, 4 << 20, 64
#: Rounds of re-estimation, and the weight of the vocabulary's own ranks against counts.
ROUNDS, PRIOR = 2, 1000.0
#: Longer words are walked one by one instead of many at once.
LONG_WORD = 48
AT_ONCE = 4096
SPACE = 0x20


# ---------------------------------------------------------------- pieces


@dataclass
class Pieces:
    """Byte strings with log probabilities, found by hash; the last entry is the end of a text."""

    names: list[bytes]
    logs: np.ndarray
    longest: int = 0

    def __post_init__(self):
        self.longest = max(map(len, self.names))
        flat = np.frombuffer(b"".join(self.names), np.uint8)
        sizes = np.fromiter(map(len, self.names), np.int64, len(self.names))
        ends = np.cumsum(sizes)
        hashes = _span_hash(flat, ends - sizes, sizes)
        self.bits = 20
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int32)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        for number, (s, h) in enumerate(zip(slot.tolist(), hashes.tolist())):
            while self.ids[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.ids[s] = h, number

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.ids[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != hashes))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.ids[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != hashes[wrong])]
        return found


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return common._powers(0, n)


def _span_hash(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return common.mix((sums[starts + sizes] - sums[starts]) * inverse[starts])


def existing(path: str) -> Pieces:
    """Pieces of a sentencepiece model file with probabilities from the ranks of its scores.

    Scores of merges are ranks, so a piece of rank r starts with a weight of 1 / (r + 1).
    Pieces with a space inside are left out; bytes that no piece spells get a small weight.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    size = model.get_piece_size()
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        name = model.id_to_piece(i).replace("▁", " ").encode()
        if name and b" " not in name[1:]:
            weight[name] = max(weight.get(name, 0.0), 1.0 / (1.0 - model.get_score(i)))
    for b in range(256):
        weight.setdefault(bytes([b]), 1.0 / (size + 1))
    names = sorted(weight)
    values = np.array([weight[n] for n in names] + [1.0 / 100])
    return Pieces(names, np.log(values / values.sum()))


# ---------------------------------------------------------------- lattices of many words


def _many(pieces: Pieces, raw: np.ndarray, starts: np.ndarray, size: int):
    """All pieces in words of one size (space included): word, from, to, piece; sorted by "to"."""
    count = len(starts)
    power, inverse = _powers(size + 1)
    sums = np.zeros((size + 1, count), np.uint64)
    letters = np.empty((size, count), np.uint64)
    letters[0] = SPACE + 1
    for k in range(1, size):
        letters[k] = raw[starts + (k - 1)]
        letters[k] += np.uint64(1)
    np.cumsum(letters * power[:size, None], axis=0, out=sums[1:])
    out = []
    for to in range(1, size + 1):
        low = max(0, to - pieces.longest)
        hashes = common.mix((sums[to] - sums[low:to]) * inverse[low:to, None])
        found = pieces.find(hashes.ravel()).reshape(hashes.shape)
        at, word = np.nonzero(found >= 0)
        out.append((to, at + low, word, found[at, word]))
    return out


def _log_sum(values: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
    """log of the sum of exp(values) per group; -inf for a group without values."""
    top = np.full(count, -np.inf)
    np.maximum.at(top, groups, values)
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.bincount(groups, weights=np.exp(values - safe[groups]), minlength=count)
    with np.errstate(divide="ignore"):
        return np.where(total > 0, safe + np.log(total), -np.inf)


def _forward(pieces: Pieces, edges, size: int, count: int) -> np.ndarray:
    alpha = np.full((size + 1, count), -np.inf)
    alpha[0] = 0.0
    for to, at, word, piece in edges:
        alpha[to] = _log_sum(alpha[at, word] + pieces.logs[piece], word, count)
    return alpha


def _backward(pieces: Pieces, edges, size: int, count: int) -> np.ndarray:
    beta = np.full((size + 1, count), -np.inf)
    beta[size] = 0.0
    flat = beta.ravel()
    for to, at, word, piece in reversed(edges):
        value = beta[to, word] + pieces.logs[piece]
        # Each (place, word) gets one term from this "to" at most.
        np.logaddexp.at(flat, at * count + word, value)
    return beta


def _runs(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of words of one size, some at a time."""
    order = np.argsort(sizes, kind="stable")
    sorted_sizes = sizes[order]
    first = np.flatnonzero(np.diff(sorted_sizes, prepend=-1))
    for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
        for at in range(a, b, AT_ONCE):
            yield int(sorted_sizes[a]), order[at : min(b, at + AT_ONCE)]


def _one(pieces: Pieces, word: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """All pieces of one long word, by the place they begin at."""
    raw = np.concatenate([np.array([SPACE], np.uint8), word])
    n = len(raw)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    begins, ends, names = [], [], []
    for length in range(1, min(pieces.longest, n) + 1):
        found = pieces.find(common.mix((sums[length:] - sums[: n + 1 - length]) * inverse[: n + 1 - length]))
        at = np.flatnonzero(found >= 0)
        begins.append(at)
        ends.append(at + length)
        names.append(found[at])
    return n, np.concatenate(begins), np.concatenate(ends), np.concatenate(names)


def _walk(pieces: Pieces, word: np.ndarray, weight: float | None, sums: np.ndarray | None) -> float:
    """Log probability of one long word; adds ``weight`` times the expected pieces to ``sums``."""
    n, begins, ends, names = _one(pieces, word)
    logs = pieces.logs[names]
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(n + 2))
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0.0
    b_of, l_of = begins[order], logs[order]
    for to in range(1, n + 1):
        some = slice(first[to], first[to + 1])
        alpha[to] = np.logaddexp.reduce(alpha[b_of[some]] + l_of[some])
    if sums is not None:
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0.0
        order = np.argsort(begins, kind="stable")
        first = np.searchsorted(begins[order], np.arange(n + 2))
        e_of, l_of = ends[order], logs[order]
        for at in range(n - 1, -1, -1):
            some = slice(first[at], first[at + 1])
            beta[at] = np.logaddexp.reduce(beta[e_of[some]] + l_of[some])
        share = np.exp(alpha[begins] + logs + beta[ends] - alpha[n])
        sums += np.bincount(names, weights=share * weight, minlength=len(sums))
    return float(alpha[n])


def word_logs(pieces: Pieces, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of the marginal probability of each word, the space before it included."""
    out = np.zeros(len(starts))
    for size, numbers in _runs(raw, starts, sizes):
        if size > LONG_WORD:
            for k in numbers.tolist():
                out[k] = _walk(pieces, raw[starts[k] : starts[k] + size], None, None)
        else:
            edges = _many(pieces, raw, starts[numbers], size + 1)
            out[numbers] = _forward(pieces, edges, size + 1, len(numbers))[size + 1]
    return out


def expected_pieces(
    pieces: Pieces, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """How often each piece is expected in all segmentations of some words, by their counts."""
    sums = np.zeros(len(pieces.logs))
    for size, numbers in _runs(raw, starts, sizes):
        if size > LONG_WORD:
            for k in numbers.tolist():
                _walk(pieces, raw[starts[k] : starts[k] + size], float(counts[k]), sums)
            continue
        width = len(numbers)
        edges = _many(pieces, raw, starts[numbers], size + 1)
        alpha = _forward(pieces, edges, size + 1, width)
        beta = _backward(pieces, edges, size + 1, width)
        total, weight = alpha[size + 1], counts[numbers].astype(float)
        for to, at, word, piece in edges:
            share = np.exp(alpha[at, word] + pieces.logs[piece] + beta[to, word] - total[word])
            sums += np.bincount(piece, weights=share * weight[word], minlength=len(sums))
    return sums


# ---------------------------------------------------------------- the corpus

BLOCKS = (
    "kind int, block bigint, bucket int, lo int, words binary, sizes binary, hashes binary, train binary, "
    "doc_ids binary, flags binary, n_words binary, codes binary"
)
_BLOCK_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("lo", pa.int32())]
    + [(c, pa.binary()) for c in ("words", "sizes", "hashes", "train", "doc_ids", "flags", "n_words", "codes")]
)
NULL_ID = -(1 << 63)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _block_rows(number: int, held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block: one with its documents, one per range of hashes with its words."""
    raw = np.concatenate([h["raw"] for h in held])
    before = np.cumsum([0, *[len(h["raw"]) for h in held]])[:-1]
    starts = np.concatenate([h["starts"] + b for h, b in zip(held, before)])
    sizes = np.concatenate([h["sizes"] for h in held])
    hashes = np.concatenate([h["hashes"] for h in held])
    n_words = np.concatenate([h["n_words"] for h in held])
    ids = np.concatenate([h["ids"] for h in held])
    train = np.concatenate([h["train"] for h in held])
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=np.repeat(train, n_words), minlength=len(unique)).astype(np.int64)
    bucket = ((unique >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    row = dict.fromkeys(_BLOCK_SCHEMA.names)

    def batch(**values):
        return pa.RecordBatch.from_arrays([pa.array([{**row, **values}[f.name]], f.type) for f in _BLOCK_SCHEMA], schema=_BLOCK_SCHEMA)

    yield batch(
        kind=1, block=number, lo=-1, doc_ids=ids.tobytes(), flags=train.astype(np.uint8).tobytes(),
        n_words=n_words.astype(np.int64).tobytes(), codes=_packed(place[inverse]),
    )
    first, unique, counts, bucket = first[order], unique[order], counts[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
        s, n = starts[first[a:b]], sizes[first[a:b]]
        ends = np.cumsum(n)
        letters = raw[np.arange(int(ends[-1])) + np.repeat(s - ends + n, n)]
        yield batch(
            kind=0, block=number, bucket=int(bucket[a]), lo=a, words=letters.tobytes(), sizes=n.astype(np.int32).tobytes(),
            hashes=unique[a:b].tobytes(), train=counts[a:b].tobytes(),
        )


def _blocks(docs: DataFrame, buckets: int, block_words: int) -> DataFrame:
    """``docs`` (doc_id, train, text) as blocks: words by range of hashes, and documents as word codes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            raw_all, offsets = common.text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in common.chunks(offsets):
                raw = raw_all[offsets[a] : offsets[b]].copy()
                raw[(raw >= 0x41) & (raw <= 0x5A)] += 0x20
                starts, ends, rows = common.word_spans(raw, offsets[a : b + 1] - offsets[a])
                held.append({
                    "raw": raw, "starts": starts, "sizes": ends - starts, "hashes": common.span_hashes(raw, starts, ends),
                    "n_words": np.diff(rows), "ids": ids[a:b], "train": train[a:b],
                })
                words += len(starts)
                if words >= block_words:
                    yield from _block_rows(number, held, buckets)
                    held, words, number = [], 0, number + 1
        if held:
            yield from _block_rows(number, held, buckets)

    return docs.select("doc_id", "train", "text").mapInArrow(cut, BLOCKS)


RANGES = "bucket int, n_train bigint, n_distinct bigint, words binary, sizes binary, counts binary, blocks array<bigint>, los array<int>, lengths array<int>, places binary"


def _ranges(blocks: DataFrame, buckets: int) -> DataFrame:
    """One row per range of hashes: its different words with training counts, and where each block's words are."""
    schema = pa.schema(
        [("bucket", pa.int32()), ("n_train", pa.int64()), ("n_distinct", pa.int64())]
        + [(c, pa.binary()) for c in ("words", "sizes", "counts")]
        + [("blocks", pa.list_(pa.int64())), ("los", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("places", pa.binary())]
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups_of(batches, ["bucket"]):
            hashes = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
            lengths = [len(h) for h in hashes]
            every = np.concatenate(hashes)
            sizes = np.frombuffer(b"".join(group.column("sizes").to_pylist()), np.int32).astype(np.int64)
            raw = np.frombuffer(b"".join(group.column("words").to_pylist()), np.uint8)
            train = np.frombuffer(b"".join(group.column("train").to_pylist()), np.int64)
            ends = np.cumsum(sizes)
            unique, first, inverse = np.unique(every, return_index=True, return_inverse=True)
            counts = np.zeros(len(unique), np.int64)
            np.add.at(counts, inverse, train)
            s, n = (ends - sizes)[first], sizes[first]
            stops = np.cumsum(n)
            letters = raw[np.arange(int(stops[-1])) + np.repeat(s - stops + n, n)]
            row = (
                group.column("bucket")[0].as_py(), int(counts.sum()), int((counts > 0).sum()), letters.tobytes(),
                n.astype(np.int32).tobytes(), counts.tobytes(), group.column("block").to_pylist(), group.column("lo").to_pylist(),
                lengths, inverse.astype(np.int32).tobytes(),
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return (
        blocks.where("kind = 0")
        .select("bucket", "block", "lo", "words", "sizes", "hashes", "train")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(reduce, RANGES)
    )


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, sizes = np.frombuffer(row["words"], np.uint8), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
    return raw, np.cumsum(sizes) - sizes, sizes, np.frombuffer(row["counts"], np.int64)


def estimate(ranges: DataFrame, pieces: Pieces, texts: int, *, rounds: int = ROUNDS, prior: float = PRIOR) -> Pieces:
    """Piece probabilities from all training words; each round adds up one number per piece."""
    spark = ranges.sparkSession
    base = np.exp(pieces.logs)
    words = ranges.where("n_train > 0").select("words", "sizes", "counts")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces.names, pieces.logs))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = Pieces(*shared.value)
            sums = np.zeros(len(here.logs))
            for batch in batches:
                for row in batch.to_pylist():
                    raw, starts, sizes, counts = _arrays(row)
                    some = np.flatnonzero(counts > 0)
                    sums += expected_pieces(here, raw, starts[some], sizes[some], counts[some])
            piece = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(sums[piece])], names=["piece", "n"])

        found = words.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros(len(base))
        sums[found.column("piece").to_numpy()] = found.column("n").to_numpy()
        sums[-1] = texts
        value = (sums + prior * base) / (sums.sum() + prior)
        pieces = Pieces(pieces.names, np.log(value))
    return pieces


RESULT = "doc_id bigint, held_out boolean, n_words bigint, n_seen bigint, log_counts double, logs double"


def scored(
    docs: DataFrame, vocabulary: str, *, rounds: int = ROUNDS, block_words: int = BLOCK_WORDS, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Scores of all whole texts of ``doc_id, train (boolean), text``.

    Returns doc_id, held_out (not train), n_tokens (words and the end), n_known (tokens seen in
    training), train_tokens, base_score (log10 probability under single words with one added to each count) and
    score (log10 of the marginal over all segmentations). A null text is empty and has its end
    alone; a null ``train`` is no training. Repeated rows are counted and scored each. Without
    training rows both models still give numbers. Words are told apart by 64-bit hashes. No
    rows: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce("train", F.lit(False)).alias("train"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    size, train_texts = rows.agg(F.sum(F.octet_length("text").cast("bigint")), F.count_if("train")).first()
    buckets = max(LEAST_RANGES, -(-(size or 0) // range_bytes))
    blocks = common.written(_blocks(rows, buckets, block_words), "lattice-blocks")
    ranges = common.written(_ranges(blocks, buckets), "lattice-ranges")
    words_seen, distinct = ranges.agg(F.sum("n_train"), F.sum("n_distinct")).first()
    total = (words_seen or 0) + train_texts
    vocabulary_size = (distinct or 0) + (train_texts > 0)
    pieces = estimate(ranges, existing(vocabulary), train_texts, rounds=rounds)
    shared = spark.sparkContext.broadcast((pieces.names, pieces.logs))
    routed = pa.schema([("block", pa.int64()), ("lo", pa.int32()), ("counts", pa.binary()), ("logs", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Pieces(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                raw, starts, sizes, counts = _arrays(row)
                logs = word_logs(here, raw, starts, sizes)
                places, at = np.frombuffer(row["places"], np.int32), 0
                out = ([], [], [], [])
                for block, lo, length in zip(row["blocks"], row["los"], row["lengths"]):
                    some = places[at : at + length]
                    at += length
                    for column, value in zip(out, (block, lo, counts[some].tobytes(), logs[some].tobytes())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, routed)], schema=routed)

    answers = ranges.select("words", "sizes", "counts", "places", "blocks", "los", "lengths").mapInArrow(
        route, "block bigint, lo int, counts binary, logs binary"
    )
    documents = blocks.where("kind = 1").select("block", "lo", "doc_ids", "flags", "n_words", "codes")
    result = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("n_seen", pa.int64()),
        ("log_counts", pa.float64()), ("logs", pa.float64()),
    ])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups_of(batches, ["block"]):
            head = group.slice(0, 1).to_pylist()[0]
            tail = group.slice(1)
            counts = np.frombuffer(b"".join(tail.column("counts").to_pylist()), np.int64)
            logs = np.frombuffer(b"".join(tail.column("logs").to_pylist()), np.float64)
            ids = np.frombuffer(head["doc_ids"], np.int64)
            n_words = np.frombuffer(head["n_words"], np.int64)
            codes = _unpacked(head["codes"], "i4", int(n_words.sum()))
            places = np.append(0, np.cumsum(n_words))

            def per_text(values):
                # Sums text by text: a running sum over all texts would lose digits.
                out = np.zeros(len(n_words), values.dtype)
                some = np.flatnonzero(n_words)
                if len(some):
                    out[some] = np.add.reduceat(values[codes], places[some])
                return out

            yield common.batch_of(
                {
                    "doc_id": pa.array(ids, mask=ids == NULL_ID), "held_out": np.frombuffer(head["flags"], np.uint8) == 0,
                    "n_words": n_words, "n_seen": per_text((counts > 0).astype(np.int64)),
                    "log_counts": per_text(np.log10(counts + 1.0)), "logs": per_text(logs),
                },
                result,
            )

    n_blocks = max(1, documents.count())
    texts = (
        documents.withColumns({c: F.lit(None).cast("binary") for c in ("counts", "logs")})
        .unionByName(answers.withColumns({c: F.lit(None).cast("binary") for c in ("doc_ids", "flags", "n_words", "codes")}))
        .repartition(n_blocks, "block")
        .sortWithinPartitions("block", "lo")
        .mapInArrow(collect, RESULT)
    )
    end_logs, ln10 = float(pieces.logs[-1]), float(np.log(10.0))
    return texts.select(
        "doc_id", "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_seen") + int(train_texts > 0)).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") + float(np.log10(train_texts + 1.0)) - (F.col("n_words") + 1) * float(np.log10(total + vocabulary_size + 1.0))).alias("base_score"),
        ((F.col("logs") + end_logs) / ln10).alias("score"),
    )
