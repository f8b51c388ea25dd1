"""Prefix polynomial hashes of texts: span equality, longest common extensions, fingerprints.

A text's code points are summed with powers of a base modulo two primes. From the prefix
sums, the hash of any span takes one subtraction and one product, so two spans of any texts
compare in constant time and the longest common extension of two places is a binary search.
The prefix sums of a joined text follow from those of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points of a fingerprinted span, and spans that a fingerprint keeps.
SPAN, KEPT = 16, 64
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, by doubling."""
    if not _TABLES or len(_TABLES[0][0]) < n:
        size, made = max(n, 1 << 16), []
        size = 1 << (size - 1).bit_length()
        for prime, base in zip(PRIMES, BASES):
            pair = []
            for x in (base, pow(base, -1, prime)):
                powers = np.ones(1, np.int64)
                while len(powers) < size:
                    powers = np.concatenate([powers, powers * pow(x, len(powers), prime) % prime])
                pair.append(powers)
            made.append(tuple(pair))
        _TABLES[:] = made
    return _TABLES


class PrefixHash:
    """Prefix arrays of one text (``sums[m][i]`` is the hash of its first i code points, modulo prime m)."""

    def __init__(self, sums: list[np.ndarray]):
        self.sums, self.length = sums, len(sums[0]) - 1

    @classmethod
    def of(cls, points: np.ndarray) -> PrefixHash:
        n = len(points)
        values, sums = points.astype(np.int64) + 1, []
        for prime, (powers, _) in zip(PRIMES, _tables(n + 1)):
            out = np.zeros(n + 1, np.int64)
            # Terms are below 2^31, so the running sum of 2^32 of them stays exact.
            np.cumsum(values * powers[:n] % prime, out=out[1:])
            sums.append(out % prime)
        return cls(sums)

    def joined(self, keep: int, other: PrefixHash, take: int) -> PrefixHash:
        """The first ``keep`` code points of this text, then the first ``take`` of the other."""
        out = []
        for m, (prime, (powers, _)) in enumerate(zip(PRIMES, _tables(keep + take + 1))):
            tail = (self.sums[m][keep] + powers[keep] * other.sums[m][1 : take + 1]) % prime
            out.append(np.concatenate([self.sums[m][: keep + 1], tail]))
        return PrefixHash(out)

    def spans(self, starts: np.ndarray, length) -> np.ndarray:
        """Hashes of the spans ``[start, start + length)``, below 2^62."""
        parts = []
        for sums, prime, (_, inverse) in zip(self.sums, PRIMES, _tables(self.length + 1)):
            parts.append((sums[starts + length] - sums[starts]) % prime * inverse[starts] % prime)
        return parts[0].astype(np.uint64) << np.uint64(31) | parts[1].astype(np.uint64)

    def windows(self, length: int, first: int = 0) -> np.ndarray:
        """Hashes of all spans of one length from place ``first`` on."""
        parts, count = [], self.length - length + 1
        if count <= first:
            return np.zeros(0, np.uint64)
        for sums, prime, (_, inverse) in zip(self.sums, PRIMES, _tables(self.length + 1)):
            parts.append((sums[first + length :] - sums[first:count]) % prime * inverse[first:count] % prime)
        return parts[0].astype(np.uint64) << np.uint64(31) | parts[1].astype(np.uint64)

    def whole(self) -> int:
        return int(self.spans(np.zeros(1, np.int64), self.length)[0])

    def equal(self, start: int, other: PrefixHash, place: int, length: int) -> bool:
        """Do two spans hold the same code points (but for a hash collision)?"""
        if start + length > self.length or place + length > other.length:
            return False
        for mine, others, prime, (powers, _) in zip(self.sums, other.sums, PRIMES, _tables(max(self.length, other.length) + 1)):
            a, b = int(mine[start + length]) - int(mine[start]), int(others[place + length]) - int(others[place])
            # Both spans are moved to the same power of the base.
            if (a * int(powers[place]) - b * int(powers[start])) % prime:
                return False
        return True

    def common_extension(self, start: int, other: PrefixHash, place: int) -> int:
        """How many code points from two places on are the same, by binary search."""
        low, high = 0, min(self.length - start, other.length - place)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, place, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _least(values: np.ndarray, kept: int) -> np.ndarray:
    """The ``kept`` smallest different values, ascending."""
    n = len(values)
    if n > 8 * kept:
        few = values[values < np.uint64(min((1 << 64) - 1, (1 << 64) // n * 4 * kept))]
        few = np.unique(few)
        if len(few) >= kept:
            return few[:kept]
    return np.unique(values)[:kept]


def sketch(hashes: np.ndarray, kept: int = KEPT) -> np.ndarray:
    return _least(common.mix(hashes), kept) >> np.uint64(16)


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated part of the spans that two sketches share (2c / (n + m)); 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:kept]
    both = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True))
    jaccard = both / len(union)
    return 2 * jaccard / (1 + jaccard)


def _name(prefix: PrefixHash, kept: np.ndarray) -> str:
    return f"{prefix.length:x}.{prefix.whole():016x}." + "".join(f"{x:012x}" for x in kept.tolist())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Document:
    """One text: prefix arrays, hashes of all spans, and its fingerprint."""

    def __init__(self, doc_id, text: str, span: int, kept: int):
        self.doc_id, self.text = doc_id, text
        self.prefix = PrefixHash.of(_points(text))
        n = self.prefix.length
        self.windows = self.prefix.windows(span) if n >= span else self.prefix.windows(n) if n else np.zeros(0, np.uint64)
        self.sketch = sketch(self.windows, kept)
        self.name = _name(self.prefix, self.sketch)

    def edited(self, following: _Document, span: int, kept: int) -> tuple[str, str, np.ndarray, int]:
        n = self.prefix.length
        cut = n // 4
        take = min(cut, following.prefix.length)
        text = self.text[: n - cut] + following.text[:take]
        if text == self.text:
            return text, self.name, self.sketch, n
        prefix = self.prefix.joined(n - cut, following.prefix, take)
        m = prefix.length
        if m >= span:
            # Spans inside the kept part have the hashes they had.
            same = max(0, n - cut - span + 1)
            hashes = np.concatenate([self.windows[:same], prefix.windows(span, same)])
        else:
            hashes = prefix.windows(m) if m else np.zeros(0, np.uint64)
        least = sketch(hashes, kept)
        return text, _name(prefix, least), least, self.prefix.common_extension(0, prefix, 0)


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, same_edited bigint, same_next bigint"
)


def fingerprints(docs: DataFrame, *, span: int = SPAN, kept: int = KEPT, shard_bytes: int = 4 << 20) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike fingerprints are.

    ``same_edited`` and ``same_next`` count the code points from the beginning on that the text shares with its edited text and
    with the next one: longest common extensions by binary search over the prefix arrays.

    The edited text has its last quarter replaced by the beginning of the next document in
    ascending doc_id order; the first one follows the last. Null doc_ids come first, equal
    ones are ordered by text, repeated rows follow each other. A null text is empty; an empty
    text has a fingerprint without spans, equal to other empty ones and unlike all else. A
    text of fewer than ``span`` code points is one span. No rows: no rows. Other columns are
    ignored. Texts are dealt by key range and shuffled once; each shard also gets a copy of
    the next shard's first document. A task holds two documents.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts = common.range_cuts(rows, "doc_id", F.octet_length("text").cast("bigint") + F.lit(64), shard_bytes)
    shards = len(cuts) + 1
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    dealt = rows.withColumns({"shard": common.shard_of("doc_id", cuts), "k": order})
    # One row per shard: the list has the bound of the cuts.
    first = F.broadcast(dealt.groupBy("shard").agg(F.min("k").alias("k")))
    heads = (
        dealt.join(first, ["shard", "k"], "left_semi")
        .groupBy("shard", "k")
        .agg(F.min("text").alias("text"))
        .select(F.pmod(F.col("shard") - 1, F.lit(shards)).alias("shard"), F.lit(True).alias("ahead"), "k", "text")
    )
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("same_edited", pa.int64()), ("same_next", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Document | None = None
        out = []
        for batch in batches:
            for ahead, k, text in zip(*(batch.column(c).to_pylist() for c in ("ahead", "k", "text"))):
                now = _Document(None if k == -(1 << 63) else k, text, span, kept)
                if before is not None:
                    edited, name, least, same = before.edited(now, span, kept)
                    out.append((
                        before.doc_id, before.prefix.length, hashlib.sha256(edited.encode()).hexdigest(), before.name, name,
                        likeness(before.sketch, least, kept), likeness(before.sketch, now.sketch, kept),
                        same, before.prefix.common_extension(0, now.prefix, 0),
                    ))
                before = None if ahead else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []

    return (
        dealt.select("shard", F.lit(False).alias("ahead"), "k", "text")
        .unionByName(heads)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "ahead", "k", "text")
        .select("ahead", "k", "text")
        .mapInArrow(run, RESULT)
    )
