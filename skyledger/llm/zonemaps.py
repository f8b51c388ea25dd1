"""Exact centroid clustering of integer vectors over zone maps in Hilbert order.

Vectors are sorted along a Hilbert curve over their most varied components and cut into blocks, each
with a box: the smallest and largest value of every component. In a round, the box tells which
centroids can be nearest to any vector of the block: one whose least distance to the box is above
another's largest cannot, nor one that is farther than another from every corner of the box. Only
those candidates are compared with the vectors, exactly, in integers. A block's box and
vectors are one row of a written table that all rounds read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

SCALE, DIMENSIONS, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Vectors of a block, and of a task that cuts blocks.
BLOCK, TASK = 256, 1 << 16
#: Components that the curve runs over, and bits of each; their product is below 63.
AXES, BITS = 16, 3
#: Components saturate here, so that every distance fits a long.
LIMIT = 1 << 26
#: Up to here, all sums of a distance are exact in doubles as well.
SMALL = 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of grid cells (``rows x axes``, each below 2^bits).

    Gray code and rotation of all rows at once, axis by axis, from the highest bit down.
    """
    x = cells.astype(np.uint64).T.copy()
    axes = len(x)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for i in range(axes):
            hit = (x[i] >> np.uint64(bit)) & one == one
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        hit = (x[-1] >> np.uint64(bit)) & one == one
        turn ^= np.where(hit, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << one | (x[i] >> np.uint64(bit)) & one
    return key


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Ascending numbers of the centroids that may be nearest to a vector of the box."""
    under, over = low - centroids, centroids - high
    least = np.square(np.maximum(0, np.maximum(under, over))).sum(axis=1)
    most = np.square(np.maximum(np.abs(under), np.abs(over))).sum(axis=1)
    best = int(most.argmin())
    # The difference of two distances is linear in the vector: it is least in a corner of the box.
    apart = centroids - centroids[best]
    corner = np.maximum(low * apart, high * apart).sum(axis=1)
    ahead = np.square(centroids).sum(axis=1) - int(np.square(centroids[best]).sum()) - 2 * corner
    return np.flatnonzero((least <= most[best]) & (ahead <= 0))


def nearest(values: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector of a block (the smaller number among equals), and the squared distance."""
    some = candidates(low, high, centroids)
    top = max(int(np.abs(low).max()), int(np.abs(high).max()), int(np.abs(centroids[some]).max()))
    kind = np.float64 if top < SMALL else np.int64
    x, c = values.astype(kind), centroids[some].astype(kind)
    apart = np.square(x).sum(axis=1)[:, None] - 2 * (x @ c.T) + np.square(c).sum(axis=1)[None, :]
    place = apart.argmin(axis=1)
    return some[place], apart[np.arange(len(x)), place].astype(np.int64)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors of a column of packed 32-bit integers."""
    joined = b"".join(v.as_buffer() for v in column)
    return np.frombuffer(joined, "<i4").reshape(-1, dimensions).astype(np.int64)


def whole_vectors(vectors: DataFrame, *, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, packed`` of the vectors with exactly ``dimensions`` components, none null or non-finite.

    ``packed`` holds ``floor(scale * x)`` of each as little-endian 32-bit integers, saturated at ``LIMIT``.
    """
    fits = F.expr(f"size(embedding) = {dimensions} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(fits)

    def packed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            with np.errstate(over="ignore"):
                values = np.clip(np.floor(scale * flat), -LIMIT, LIMIT).astype("<i4")
            yield pa.array([row.tobytes() for row in values], pa.binary())

    pack = F.arrow_udf(packed, "binary")
    return rows.select("vec_id", pack("embedding").alias("packed"))


def _spread(kept: DataFrame, dimensions: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors there are, and mean and deviation of each component, from sums over all."""
    schema = pa.schema([("place", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("squares", pa.float64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            x = _matrix(batch.column("packed"), dimensions).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + np.square(x).sum(axis=0)
        if n:
            yield common.batch_of({"place": np.arange(dimensions), "n": np.full(dimensions, n), "total": total, "squares": squares}, schema)

    sums = kept.select("packed").mapInArrow(add, "place int, n bigint, total double, squares double")
    rows = sums.groupBy("place").agg(F.sum("n"), F.sum("total"), F.sum("squares")).orderBy("place").collect()
    if not rows:
        return 0, np.zeros(dimensions), np.zeros(dimensions)
    n, total, squares = (np.array([r[k] for r in rows], np.float64) for k in (1, 2, 3))
    return int(n[0]), total / n, np.sqrt(np.maximum(0, squares / n - np.square(total / n)))


def blocks(
    kept: DataFrame, *, dimensions: int = DIMENSIONS, block: int = BLOCK, axes: int = AXES, bits: int = BITS
) -> DataFrame:
    """The written zone map of ``vec_id, row, packed``: one row per block, in Hilbert order.

    Columns ``vec_ids, packed`` (all vectors of the block), ``low, high`` (its box). A block ends where the curve enters
    another of its 2^axes largest cells, unless it has less than a quarter of ``block`` vectors then. ``row`` must be unique and
    stored: equal vectors are told apart by it, so that no number of them falls to one task.
    """
    count, mean, deviation = _spread(kept, dimensions)
    # The curve runs over the components that vary most; each is cut at even steps within two deviations.
    picked = np.argsort(-deviation, kind="stable")[: min(axes, dimensions)]
    low, step = mean[picked] - 2 * deviation[picked], np.maximum(deviation[picked], 1e-9) * 4 / (1 << bits)

    def keys(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            x = _matrix(column, dimensions)[:, picked]
            cells = np.clip(np.floor((x - low) / step), 0, (1 << bits) - 1)
            yield pa.array(hilbert_keys(cells, bits).astype(np.int64))

    schema = pa.schema([
        ("vec_ids", pa.list_(pa.int64())), ("packed", pa.binary()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        least = max(1, block // 4)

        def closed(rows: pa.Table) -> pa.RecordBatch:
            values = _matrix(rows.column("packed").combine_chunks(), dimensions)
            return common.batch_of({
                "vec_ids": [rows.column("vec_id").to_pylist()], "packed": [values.astype("<i4").tobytes()],
                "low": [values.min(axis=0).tolist()], "high": [values.max(axis=0).tolist()],
            }, schema)

        for batch in batches:
            held.append(batch)
            rows, at = pa.Table.from_batches(held), 0
            # The curve's first turns: vectors of one cell lie on the same side of every axis.
            cell = rows.column("key").to_numpy() >> (min(axes, dimensions) * (bits - 1))
            turns = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            while rows.num_rows - at > block:
                turn = turns[np.searchsorted(turns, at + least) :][:1]
                end = min(at + block, *turn.tolist()) if len(turn) else at + block
                yield closed(rows.slice(at, end - at))
                at = end
            held = rows.slice(at).to_batches()
        if sum(b.num_rows for b in held):
            yield closed(pa.Table.from_batches(held))

    key = F.arrow_udf(keys, "bigint")
    ordered = (
        kept.withColumn("key", key("packed"))
        .repartitionByRange(max(1, -(-count // TASK)), "key", "row")
        .sortWithinPartitions("key", "row")
        .select("vec_id", "packed", "key")
    )
    kind = "vec_ids array<bigint>, packed binary, low array<int>, high array<int>"
    return common.written(ordered.mapInArrow(cut, kind), "zone-maps")


def _blocks_of(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        values = np.frombuffer(batch.column("packed")[k].as_buffer(), "<i4").reshape(-1, dimensions).astype(np.int64)
        low, high = (batch.column(name)[k].values.to_numpy().astype(np.int64) for name in ("low", "high"))
        yield batch.column("vec_ids")[k].values, values, low, high


def _moved(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means, from one sum per cluster and component."""
    k, dimensions = centroids.shape
    shared = zones.sparkSession.sparkContext.broadcast(centroids)
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, values, low, high in _blocks_of(batch, dimensions):
                cluster, _ = nearest(values, low, high, shared.value)
                n += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster).tolist():
                    total[c] += values[cluster == c].sum(axis=0)
        some = np.flatnonzero(n)
        if len(some):
            yield common.batch_of({
                "cluster": np.repeat(some, dimensions), "place": np.tile(np.arange(dimensions), len(some)),
                "total": total[some].ravel(), "n": np.repeat(n[some], dimensions),
            }, schema)

    sums = (
        zones.mapInArrow(add, "cluster int, place int, total bigint, n bigint")
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    )
    out = centroids.copy()
    for row in sums.collect():
        out[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return out


def _name_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def clustered(
    vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1:", dimensions: int = DIMENSIONS,
    scale: int = SCALE, block: int = BLOCK, axes: int = AXES, bits: int = BITS,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``vectors`` (``vec_id, embedding``).

    Vectors of another length, or with a null or non-finite component, are left out; so is a null embedding.
    Centroids start as the vectors with the smallest SHA-256 of seed and vec_id, equal ones ordered by
    components; rows with a null vec_id come last, but are assigned like others. Fewer vectors than ``clusters`` start fewer
    centroids; no vectors: no rows. Repeated rows count each. Components beyond 2^26 after scaling saturate
    there, and sums of distances at the largest long. Other columns are ignored. The driver holds
    the centroids alone; equal vectors are spread over blocks.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, dimensions=dimensions, scale=scale).withColumn("row", F.monotonically_increasing_id())
    kept = common.written(kept, "whole-vectors")
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "packed").limit(clusters).select("packed").collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.stack([np.frombuffer(r[0], "<i4") for r in first]).astype(np.int64)
    zones = blocks(kept, dimensions=dimensions, block=block, axes=axes, bits=bits)
    for _ in range(rounds):
        centroids = _moved(zones, centroids)
    shared = spark.sparkContext.broadcast(centroids)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, values, low, high in _blocks_of(batch, dimensions):
                cluster, distance = nearest(values, low, high, shared.value)
                yield common.batch_of({"vec_id": names, "cluster": cluster, "distance": distance}, schema)

    assigned = common.written(zones.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()
    most = (1 << 63) - 1
    total = min(most, sum(int(r["x"]) for r in sums))
    side = [(r["cluster"], min(most, int(r["x"])), total, _name_of(centroids[r["cluster"]])) for r in sums]
    named = spark.createDataFrame(side, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per cluster: their number is a parameter.
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
