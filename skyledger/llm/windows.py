"""Packing by non-negative least squares over combinations of lengths.

Documents longer than a window are cut into full ones and a rest. All other lengths make one histogram over
the whole input. From it, a plan: for each window, from the smallest power of two up to the capacity,
combinations of at most three lengths (in 64ths of the window) that fill it, and how often to
repeat each, solved by non-negative least squares against the histogram and rounded. What fills a window goes into
the next one as a single length. Then cells of documents follow the plan; what the plan leaves over is best-fitted,
and the emptiest sequences are cut up to close all gaps. The last tokens of a cell become sequences whose lengths are powers of two.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common
from skyledger.llm.tokens import cached_tokenizer

CAPACITY = 4096
#: Parts that a window is divided into, and lengths of a combination.
UNITS, DEPTH = 64, 3
#: Documents of a cell, on average. One task packs a cell, and holds its ids.
CELL_ITEMS = 8192
#: Ids that a task returns at once.
OUT_IDS = 1 << 19

Plan = list[tuple[int, list[tuple[tuple[int, ...], float]]]]


def combinations(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to write ``units`` as a sum of at most ``depth`` descending numbers."""

    def below(left: int, most: int, places: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
        elif places:
            for part in range(min(left, most), 0, -1):
                for rest in below(left - part, part, places - 1):
                    yield (part, *rest)

    return list(below(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The non-negative x with the least ``|a x - b|``, by the active-set method of Lawson and Hanson."""
    gram, target = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = target.copy()
    least = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        slope[free] = -np.inf
        into = int(slope.argmax())
        if slope[into] <= least:
            break
        free[into] = True
        while True:
            some = np.flatnonzero(free)
            best = np.linalg.lstsq(gram[np.ix_(some, some)], target[some], rcond=None)[0]
            if best.min(initial=1) > 0:
                x[some] = best
                break
            # Go towards the optimum of the free ones until the first of them is zero.
            low = best <= 0
            now = x[some]
            step = float((now[low] / np.maximum(now[low] - best[low], 1e-300)).min())
            x[some] = now + step * (best - now)
            out = some[(x[some] <= 1e-12 * (1 + x.max())) & low]
            x[out], free[out] = 0, False
            if not len(out):
                break
        slope = target - gram @ x
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, units: int = UNITS, depth: int = DEPTH) -> Plan:
    """Per window, ascending: the combinations in use, and repeats of each per item of the histogram.

    ``histogram`` counts the items of each length below ``capacity``. Rows of the system are weighted by their
    length, as long items are harder to place later.
    """
    items = sum(histogram.values())
    if not items:
        return []
    ways = combinations(units, depth)
    parts = np.zeros((units, len(ways)))
    for k, way in enumerate(ways):
        for part in way:
            parts[part - 1, k] += 1
    weight = np.sqrt(np.arange(1, units + 1))
    out: Plan = []
    have, window, below = np.zeros(units), units, 0
    while window <= capacity:
        step = window // units
        for length, count in histogram.items():
            if below < length <= window:
                have[-(-length // step) - 1] += count
        wanted = nnls(weight[:, None] * parts, weight * have)
        chosen, left = [], have.copy()
        for k in np.argsort(-wanted, kind="stable").tolist():
            used = np.flatnonzero(parts[:, k])
            repeats = min(np.floor(wanted[k] + 0.5), np.floor((left[used] / parts[used, k]).min()))
            if wanted[k] <= 0:
                break
            if repeats > 0:
                left -= repeats * parts[:, k]
                chosen.append((ways[k], repeats / items))
        out.append((window, chosen))
        # In the next window, units are twice as wide; a full window is half of it.
        full = sum(share * items for _, share in chosen)
        have = np.zeros(units)
        np.add.at(have, (np.arange(units)) // 2, left)
        have[units // 2 - 1] += full
        below, window = window, 2 * window
    return out


def _follow(lengths: np.ndarray, steps: Plan, capacity: int, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Join items as planned. Chains of items: first item, last item, total; how many are sequences; and the links."""
    n = len(lengths)
    link = np.full(n, -1, np.int64)
    first, last, total = (np.zeros(0, np.int64) for _ in range(3))
    below, done = 0, 0
    for window, ways in steps:
        new = np.flatnonzero((lengths > below) & (lengths <= window))
        first, last, total = np.append(first, new), np.append(last, new), np.append(total, lengths[new])
        size = -(-total // (window // units))
        order = np.lexsort((first, total, size))
        edges = np.searchsorted(size[order], np.arange(units + 2))
        at, taken = edges[:-1].copy(), []
        for way, share in ways:
            number = int(np.ceil(share * n))
            for part in set(way):
                number = min(number, int(edges[part + 1] - at[part]) // way.count(part))
            if not number:
                continue
            heads = []
            for part in way:
                heads.append(order[at[part] : at[part] + number])
                at[part] += number
            for one, following in zip(heads, heads[1:]):
                link[last[one]] = first[following]
            taken.append((first[heads[0]], last[heads[-1]], sum(total[h] for h in heads)))
        rest = np.concatenate([order[at[u] : edges[u + 1]] for u in range(1, units + 1)] or [order])
        made = [np.concatenate(x) for x in zip(*taken)] if taken else [np.zeros(0, np.int64)] * 3
        first, last, total = (np.append(m, old[rest]) for m, old in zip(made, (first, last, total)))
        below, done = window, len(made[0])
    return first, last, total, done, link


def pack_cell(
    lengths: np.ndarray, steps: Plan, capacity: int = CAPACITY, units: int = UNITS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of one cell: item, start in it, length, sequence, offset there.

    Every sequence but the last few is full; those have descending powers of two as lengths.
    """
    lengths = lengths.astype(np.int64)
    first, last, total, done, link = _follow(lengths, steps, capacity, units)
    # What the plan left over goes where it fits best, the longest first.
    sequences, totals = first[:done].tolist(), total[:done].tolist()
    ends, gaps = last[:done].tolist(), sorted((capacity - t, k) for k, t in enumerate(total[:done].tolist()) if t < capacity)
    for k in sorted(range(done, len(first)), key=lambda k: (-total[k], first[k])):
        size, at = int(total[k]), bisect_left(gaps, (int(total[k]), -1))
        if at < len(gaps):
            free, where = gaps.pop(at)
            link[ends[where]] = first[k]
            ends[where], totals[where] = int(last[k]), totals[where] + size
        else:
            free, where = capacity, len(sequences)
            sequences.append(int(first[k]))
            ends.append(int(last[k]))
            totals.append(size)
        if free > size:
            insort(gaps, (free - size, where))
    heads, fill = np.array(sequences, np.int64), np.array(totals, np.int64)
    # Items of each sequence in order, with their offsets.
    owner, item, offset = [], [], []
    now, at, alive = heads.copy(), np.zeros(len(heads), np.int64), np.arange(len(heads))
    while len(alive):
        owner.append(alive)
        item.append(now)
        offset.append(at)
        at, now = at + lengths[now], link[now]
        there = now >= 0
        alive, now, at = alive[there], now[there], at[there]
    owner, item, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, item, offset))
    # The emptiest sequences are cut up: as many as hold what the others lack.
    cut = -(-int((capacity - fill).sum()) // capacity)
    emptiest = np.argsort(fill, kind="stable")
    donor = np.zeros(len(fill), bool)
    donor[emptiest[:cut]] = True
    name = np.cumsum(~donor) - 1
    whole = ~donor[owner]
    out = [(item[whole], np.zeros(int(whole.sum()), np.int64), lengths[item[whole]], name[owner[whole]], offset[whole])]
    loose = item[~whole][np.lexsort((offset[~whole], owner[~whole]))]
    if len(loose):
        open_ = np.flatnonzero(~donor & (fill < capacity))
        open_ = open_[np.argsort(fill[open_], kind="stable")]
        rest = int(lengths[loose].sum() - (capacity - fill[open_]).sum())
        powers = np.array([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
        slot = np.concatenate([capacity - fill[open_], powers])
        slot_name = np.concatenate([name[open_], int((~donor).sum()) + np.arange(len(powers))])
        slot_at = np.concatenate([fill[open_], np.zeros(len(powers), np.int64)])
        begins, places = np.cumsum(lengths[loose]) - lengths[loose], np.cumsum(slot) - slot
        starts = np.union1d(begins, places)
        sizes = np.diff(np.append(starts, lengths[loose].sum()))
        of, into = np.searchsorted(begins, starts, side="right") - 1, np.searchsorted(places, starts, side="right") - 1
        out.append((loose[of], starts - begins[of], sizes, slot_name[into], slot_at[into] + starts - places[into]))
    return tuple(np.concatenate(x) for x in zip(*out))


# ---------------------------------------------------------------- all documents


def _binary(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of ids that follow each other, as binaries of little-endian unsigned 32-bit integers."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(4 * lengths, out=ends[1:])
    data = np.ascontiguousarray(ids, "<u4")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def token_items(docs: DataFrame, tokenizer: str, *, end: int, drops_space: bool, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` of every document's ids and end id, cut where a full sequence is reached.

    ``ids`` are little-endian unsigned 32-bit integers. A null text is empty and has the end id alone.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_tokenizer(tokenizer, drops_space)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = encoder.encode_all(batch.column("text"), end)
            whole = np.fromiter(map(len, ids), np.int64, len(ids))
            parts = -(-whole // capacity)
            owner = np.repeat(np.arange(len(ids)), parts)
            start = capacity * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
            length = np.minimum(capacity, whole[owner] - start)
            yield common.batch_of({
                "doc_id": batch.column("doc_id").take(pa.array(owner)), "start": start, "length": length,
                "doc_tokens": whole[owner], "ids": _binary(np.concatenate(ids), length),
            }, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary")


PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"


def packed_documents(
    docs: DataFrame, tokenizer: str, *, end: int, drops_space: bool, capacity: int = CAPACITY, units: int = UNITS,
    depth: int = DEPTH, cell_items: int = CELL_ITEMS,
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, sequence_id, offset`` of all pieces of ``docs`` (``doc_id, text``).

    A piece holds ``length`` ids of its document from ``start`` on (``ids``: little-endian unsigned 32-bit integers), at
    ``offset`` of its sequence. Sequences hold ``capacity`` ids, a power of two of at least ``units``; at most twelve a cell are shorter, and
    have a power of two of ids as well, so nothing is padded. A null text is empty and has the end id alone; equal rows are packed each.
    No rows: no rows. Other columns are ignored. Items are dealt evenly into cells by a hash of a stored row number, so neither a
    frequent text nor a frequent length gathers in one task; the driver holds the histogram, at most ``capacity`` counts, and the plan.
    """
    if capacity & (capacity - 1) or capacity < units:
        raise ValueError("the capacity must be a power of two, and hold the units")
    items = token_items(docs, tokenizer, end=end, drops_space=drops_space, capacity=capacity)
    items = common.written(items.withColumn("item", F.monotonically_increasing_id()), "token-items")
    full = items.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("bigint")})
    loose = items.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in loose.groupBy("length").count().collect()}
    cells = max(1, -(-sum(histogram.values()) // cell_items))
    steps = items.sparkSession.sparkContext.broadcast(plan(histogram, capacity, units, depth))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups_of(batches, ["cell"]):
            cell = group.column("cell")[0].as_py()
            lengths, starts = group.column("length").to_numpy(), group.column("start").to_numpy()
            item, start, length, sequence, offset = pack_cell(lengths, steps.value, capacity, units)
            order = np.lexsort((start, item))
            item, start, length, sequence, offset = (x[order] for x in (item, start, length, sequence, offset))
            names, whole = group.column("doc_id").combine_chunks(), group.column("doc_tokens").to_numpy()
            packed = group.column("ids").combine_chunks()
            ids = np.frombuffer(packed.buffers()[2], "<u4")
            first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed)] // 4
            ends = np.cumsum(length)
            a = 0
            while a < len(item):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + OUT_IDS)))
                size = length[a:b]
                places = np.arange(int(size.sum())) + np.repeat(first[item[a:b]] + start[a:b] - (np.cumsum(size) - size), size)
                yield common.batch_of({
                    "doc_id": names.take(pa.array(item[a:b])), "start": starts[item[a:b]] + start[a:b], "length": size,
                    "doc_tokens": whole[item[a:b]], "ids": _binary(ids[places], size),
                    "sequence_id": cell * (1 << 20) + sequence[a:b], "offset": offset[a:b],
                }, schema)
                a = b

    packed = (
        loose.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(cells)))
        .repartition(cells, "cell")
        .sortWithinPartitions("cell", "item")
        .select("cell", "doc_id", "start", "length", "doc_tokens", "ids")
        .mapInArrow(pack, PIECES)
    )
    return packed.unionByName(full.select(*[c.split()[0] for c in PIECES.split(", ")]))
