"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Items are dealt into cells of a few thousand. Several islands evolve packings of the same
cell: a child takes whole well-filled bins of one parent, drops the bins of the other
parent that share a document with them, and best-fits the displaced documents, longest first.
Between epochs each island sends its best packings to the next island by a shuffle. An
island stops as soon as it meets the lower bound of its cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common
from skyledger.llm.tokens import cached_tokenizer, crc_of

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Items of a cell, on average; a cell is the unit that one island packs.
CELL_ITEMS = 4096
ISLANDS, EPOCHS = 3, 2
POPULATION, GENERATIONS, ELITES = 6, 12, 2


def token_pieces(
    docs: DataFrame, tokenizer: str, *, end: int, drops_space: bool, capacity: int = 1024
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with the end id.

    Only longer documents are cut; the first piece is the shorter one then. A null text is
    empty and gives one piece with the end id. Repeated rows give repeated pieces.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_tokenizer(tokenizer, drops_space)
        for batch in batches:
            names, rows = batch.column("doc_id").to_pylist(), []
            for name, ids in zip(names, encoder.encode_all(batch.column("text"), end)):
                first = len(ids) % capacity or min(capacity, len(ids))
                start, piece = 0, 0
                while start < len(ids):
                    stop = first if piece == 0 else start + capacity
                    rows.append((name, piece, start, stop - start, crc_of(ids[start:stop])))
                    start, piece = stop, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES)


# ---------------------------------------------------------------- one island


class _Bins:
    """Open bins by free space; finds the fullest bin that still takes an item."""

    def __init__(self, capacity: int):
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.capacity, self.count = 0, capacity, 0

    def add(self, name: int, free: int):
        if free:
            self.by_free[free].append(name)
            self.mask |= 1 << free

    def place(self, length: int) -> int:
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            name = self.by_free[free].pop()
            if not self.by_free[free]:
                self.mask ^= 1 << free
        else:
            name, free = self.count, self.capacity
            self.count += 1
        self.add(name, free - length)
        return name


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item when items are best-fitted in ``order``."""
    bins, out = _Bins(capacity), np.empty(len(lengths), np.int32)
    out[order] = [bins.place(x) for x in lengths[order].tolist()]
    return out


def cross(
    a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator
) -> np.ndarray:
    """A child of two packings: bins of ``b`` go into ``a`` whole, displaced items are best-fitted."""
    fill = np.bincount(b, weights=lengths)
    well = np.flatnonzero(fill >= capacity - rng.integers(0, 4))
    if not len(well):
        well = np.flatnonzero(fill == fill.max())
    share = rng.uniform(0.3, 0.9)
    chosen = np.zeros(len(fill), bool)
    chosen[well[rng.random(len(well)) < share]] = True
    injected = chosen[b]
    fill_a = np.bincount(a, weights=lengths)
    touched = np.zeros(len(fill_a), bool)
    touched[a[injected]] = True
    # A few loosely filled bins of the first parent are opened as well.
    touched |= (fill_a < capacity) & (rng.random(len(fill_a)) < 0.5)
    stay = ~touched[a] & ~injected
    child = np.full(len(a), -1, np.int32)
    names, child[injected] = np.unique(b[injected], return_inverse=True)
    kept, places = np.unique(a[stay], return_inverse=True)
    child[stay] = places + len(names)
    bins = _Bins(capacity)
    bins.count = len(names) + len(kept)
    some = child >= 0
    used = np.bincount(child[some], weights=lengths[some], minlength=bins.count).astype(int)
    for name in np.flatnonzero(used < capacity).tolist():
        bins.add(name, capacity - int(used[name]))
    loose = np.flatnonzero(~some)
    noise = rng.uniform(0, rng.choice([0, 0, 8, 64]) + 1e-9, len(loose))
    loose = loose[np.argsort(-(lengths[loose] + noise), kind="stable")]
    child[loose] = [bins.place(x) for x in lengths[loose].tolist()]
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def score(packing: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals the one whose bins are filled less evenly."""
    fill = np.bincount(packing, weights=lengths) / capacity
    return len(fill), -float((fill * fill).sum())


def evolve(
    lengths: np.ndarray, capacity: int, seed: int, guests: list[np.ndarray], *, population: int, generations: int
) -> list[np.ndarray]:
    """Packings of one cell, best first, after some generations on one island."""
    bound = -(-int(lengths.sum()) // capacity)
    rng = np.random.default_rng(seed)
    people = list(guests)
    if not people:
        people.append(best_fit(lengths, np.argsort(-lengths, kind="stable"), capacity))
    rated = [(score(p, lengths, capacity), k, p) for k, p in enumerate(people)]
    if min(rated)[0][0] <= bound:
        return [min(rated, key=lambda r: r[:2])[2]]
    while len(rated) < population:
        noise = rng.uniform(0, 2 ** rng.uniform(2, 8), len(lengths))
        p = best_fit(lengths, np.argsort(-(lengths + noise), kind="stable"), capacity)
        rated.append((score(p, lengths, capacity), len(rated), p))
    number = len(rated)
    for _ in range(generations):
        rated.sort(key=lambda r: r[:2])
        if rated[0][0][0] <= bound:
            break
        i, j = rng.integers(0, max(2, population // 2)), rng.integers(0, len(rated))
        if i == j:
            j = (j + 1) % len(rated)
        child = cross(rated[i][2], rated[j][2], lengths, capacity, rng)
        number += 1
        rated = [*rated[: population - 1], (score(child, lengths, capacity), number, child)]
    rated.sort(key=lambda r: r[:2])
    return [r[2] for r in rated]


# ---------------------------------------------------------------- all cells


def pack(
    items: DataFrame,
    *,
    capacity: int = 1024,
    cell_items: int = CELL_ITEMS,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    generations: int = GENERATIONS,
) -> DataFrame:
    """``item, sequence_id, offset`` for rows ``item bigint, length bigint``.

    ``item`` must be unique and not null; lengths are 1 to ``capacity``, any other length
    fails the job. Items of full length are sequences of their own and take no part. The
    rest is dealt evenly into cells by a hash, so a cell's size does not follow the input's. No items: no rows.
    Sequence ids of cells are ``cell * 2^21 + bin``; a full item's id is ``-1 - item``.
    """
    items = items.select(
        "item", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit("length out of range"))).cast("int").alias("length")
    )
    full = items.where(F.col("length") == capacity).select(
        "item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    loose = items.where(F.col("length") < capacity)
    cells = max(1, -(-loose.count() // cell_items))
    # A cell holds a bounded number of items, as the number of cells follows their count.
    state = (
        loose.groupBy(F.pmod(F.xxhash64("item"), F.lit(cells)).alias("cell"))
        .agg(F.sort_array(F.collect_list(F.struct("length", "item"))).alias("x"))
        .select("cell", F.col("x.item").alias("items"), F.col("x.length").alias("lengths"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.expr("array()").cast("array<array<int>>").alias("guests"))
    )
    kind = "cell bigint, items array<bigint>, lengths array<int>, island int, guests array<array<int>>"
    schema = pa.schema([
        ("cell", pa.int64()), ("items", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
        ("island", pa.int32()), ("guests", pa.list_(pa.list_(pa.int32()))),
    ])

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    lengths = np.asarray(row.column("lengths")[0].values, dtype=np.int64)
                    cell, island = row.column("cell")[0].as_py(), row.column("island")[0].as_py()
                    guests = [np.asarray(g.values, dtype=np.int32) for g in row.column("guests")[0]]
                    best = evolve(
                        lengths, capacity, (cell * 1009 + island) * 1009 + number, guests,
                        population=population, generations=generations,
                    )[:ELITES]
                    yield pa.RecordBatch.from_arrays(
                        [row.column("cell"), row.column("items"), row.column("lengths"), row.column("island"),
                         pa.array([[p.tolist() for p in best]], schema.field("guests").type)],
                        schema=schema,
                    )

        return run

    for number in range(epochs):
        if number:
            # The elite of an island goes to the next one on the ring.
            moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            state = (
                state.unionByName(moved)
                .groupBy("cell", "island")
                .agg(F.first("items").alias("items"), F.first("lengths").alias("lengths"), F.flatten(F.collect_list("guests")).alias("guests"))
                .select("cell", "items", "lengths", "island", "guests")
            )
        else:
            state = state.repartition(max(1, min(cells * islands, 1 << 16)), "cell", "island")
        state = common.written(state.mapInArrow(epoch(number), kind), "packing-epoch")

    placed = pa.schema([("item", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names = np.asarray(batch.column("items")[k].values, dtype=np.int64)
                lengths = np.asarray(batch.column("lengths")[k].values, dtype=np.int64)
                bins = np.asarray(batch.column("bins")[k].values, dtype=np.int64)
                order = np.lexsort((names, -lengths, bins))
                ends = np.cumsum(lengths[order])
                starts = ends - lengths[order]
                first = np.flatnonzero(np.diff(bins[order], prepend=-1))
                base = np.repeat(starts[first], np.diff(np.append(first, len(order))))
                yield common.batch_of(
                    {"item": names[order], "sequence_id": batch.column("cell")[k].as_py() * (1 << 21) + bins[order], "offset": starts - base},
                    placed,
                )

    best = (
        state.select("cell", "items", "lengths", F.explode("guests").alias("bins"))
        .groupBy("cell")
        .agg(F.min_by(F.struct("items", "lengths", "bins"), F.array_max("bins")).alias("x"))
        .select("cell", "x.*")
    )
    return best.mapInArrow(place, "item bigint, sequence_id bigint, offset bigint").unionByName(full)


def packed_documents(docs: DataFrame, tokenizer: str, *, end: int, drops_space: bool, capacity: int = 1024, **options) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs``."""
    cut = token_pieces(docs, tokenizer, end=end, drops_space=drops_space, capacity=capacity)
    pieces = common.written(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("item", "length"), capacity=capacity, **options), "item").drop("item")
