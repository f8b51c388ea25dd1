"""Helpers that the text operators share: Arrow buffers, hashes, shards and written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import prepare, work_dir

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Rows and bytes that one Arrow batch may bring to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Bytes of text that the vectorised helpers work on at once.
CHUNK = 1 << 19


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but for some names."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster."""
    return work_dir(spark, name)


def written(df: DataFrame, name: str, **columns) -> DataFrame:
    """``df`` as a written table: its lineage ends, and a lost executor costs no work of others."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path there."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        uri = uri[5:]
    return pafs.LocalFileSystem(), uri


def commit_file(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write under a temporary name of its own, then move: a reader sees a whole file or none."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, path)


# ---------------------------------------------------------------- shards by key range


def range_cuts(
    df: DataFrame, key: str, weight: Column, target: int, *, buckets: int = 4096, rounds: int = 24, most: int = 1 << 16
) -> list[int]:
    """Lower bounds of key ranges that hold about ``target`` of ``weight`` each.

    The bounds come from exact sums per key interval, so they depend on the rows alone and
    not on their order or partitions. Intervals that hold more than ``target`` are divided
    again, each into at least as many parts as it needs ranges, twice over, until none is left or ``rounds`` jobs have run. A single
    key is never divided. Null keys belong to the first range. There are about ``most``
    ranges at most; beyond that ``target`` grows, so the lists have a fixed bound.
    """
    bounds = df.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if bounds is None or bounds[0] is None:
        return []
    target = max(target, -(-int(bounds[2]) // most))
    value = F.col(key).cast("bigint")
    edges, sums = [(int(bounds[0]), int(bounds[1]))], {int(bounds[0]): int(bounds[2])}
    for _ in range(rounds):
        if not edges:
            break
        intervals = []
        for low, high in edges:
            parts = max(buckets // len(edges), 2 * -(-sums.pop(low) // target))
            intervals.append((low, high, max(1, -(-(high - low + 1) // parts))))
        lows, highs, steps = ([int(x[k]) for x in intervals] for k in range(3))
        # The interval of a key is found by halving; keys of intervals that are small enough fall between them.
        place = F.greatest(_rank(value, F.lit(lows), len(lows)) - 1, F.lit(0))
        low, high, step = (F.get(F.lit(x), place) for x in (lows, highs, steps))
        found = (
            df.where(value.isNotNull()).select(value.alias("__key"), weight.alias("__weight"), low.alias("__low"), high.alias("__high"), step.alias("__step"))
            .where(F.col("__key").between(F.col("__low"), F.col("__high")))
            .groupBy("__low", F.expr("(__key - __low) div __step").alias("n")).agg(F.sum("__weight").alias("w"))
            .select((F.col("__low")).alias("low"), "n", "w").collect()
        )
        size = {x[0]: x for x in intervals}
        edges = []
        for row in found:
            low, high, step = size[row["low"]]
            start = low + row["n"] * step
            sums[start] = int(row["w"] or 0)
            if sums[start] > target and step > 1 and start < high:
                edges.append((start, min(high, start + step - 1)))
        edges.sort()
    cuts, total = [], 0
    for k in sorted(sums):
        if total and total + sums[k] > target:
            cuts.append(k)
            total = 0
        total += sums[k]
    return cuts


def shard_of(key: str, cuts: list[int]) -> Column:
    """The number of the key's range; null keys are in range 0."""
    if not cuts:
        return F.lit(0)
    bounds = F.lit(cuts)
    value = F.col(key).cast("bigint")
    return F.when(value.isNull(), 0).otherwise(_rank(value, bounds, len(cuts)))


def _rank(value: Column, bounds: Column, n: int) -> Column:
    """How many of the ascending bounds are at or below the value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])

    def halve(low, step):
        return F.when((low + step <= n) & (F.get(bounds, low + step - 1) <= value), low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), halve)


# ---------------------------------------------------------------- texts as buffers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``size`` bytes; a longer row is a run of its own."""
    size = size or CHUNK
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the number of words in the rows before it."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = {0: 0x9E3779B97F4A7C15 | 1, 1: 0xC2B2AE3D27D4EB4F | 1}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE[seed], -1, 1 << 64)
        have = tuple(
            np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, dtype=np.uint64)]).cumprod(dtype=np.uint64)
            for x in (_BASE[seed], inverse)
        )
        _POWERS[seed] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order, by prefix sums of powers."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
        high = int(ends[last - 1])
        power, inverse = _powers(seed, high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        first = last
    return out


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` following words in a row, and their row numbers.

    ``rows`` counts the words before each row. A row of fewer words, but at least one,
    has one shingle of all its words.
    """
    counts = np.diff(rows)
    order = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(words)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        sums[: n - k] += words[k:] * order[k]
    of_word = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - rows[of_word]
    whole = place + width <= counts[of_word]
    short = np.flatnonzero((counts > 0) & (counts < width))
    hashes, owner = mix(sums[whole]), of_word[whole]
    if len(short):
        first = rows[short]
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += words[first[has] + k] * order[k]
        extra = mix(extra ^ counts[short].astype(np.uint64))
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
    return hashes, owner


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        value = columns[field.name]
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive sorted by ``keys``; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = [*np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            key = tuple(v[a] for v in values)
            if current is not None and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
