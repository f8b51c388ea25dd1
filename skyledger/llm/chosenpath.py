"""Chosen-path similarity join of documents on sets of word shingles.

Equal sets are one set with a number of copies. Each run starts one path per set, on a sampled
token: the ``RUNS`` smallest hashes of each set. Near sets share most of their starts, so they
also share one among the rarest: a set follows only as many starts, rarest first, as leave fewer than
near sets share. Sets that meet on a path are a bucket. A bucket of two is a
candidate pair. In a larger one, all sets are compared by sketches with the one that meets most others: if none is
unlike it the bucket is settled, else the unlike ones go on, with those that one of them may be near, on paths extended by more sampled
tokens of theirs, until buckets are small. What is left after the last extension stays
together. The target recall is divided among the three places where a near pair can be lost: the starts, the
estimate from sketches, and the extensions. Candidate pairs make groups; inside each group, all sets are compared exactly by brute force in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.999999
#: Starts of a set, tokens of a sketch, and extensions of a path.
RUNS, SKETCH, DEPTH = 32, 48, 2
#: Unlike sets of a bucket that share this part of their sketches join the alike ones if there are this many times as many of those or more.
CLOSE, FEW = 0.25, 1
#: Places where a near pair can be lost.
PLACES = 3
#: Tokens and sets of a tile of brute force.
TILE_TOKENS, TILE_SETS = 500_000, 1500


def shared_at_least(sample: int, threshold: float, loss: float) -> int:
    """How many of so many smallest hashes of their union near sets share, but for a probability of ``loss``.

    Each of them is shared with a probability of ``threshold`` or more: an exact binomial tail.
    """
    below, number = 0.0, 0
    while number < sample:
        below += math.comb(sample, number) * threshold**number * (1 - threshold) ** (sample - number)
        if below > loss:
            break
        number += 1
    return number


def starts_followed(size: int, runs: int = RUNS, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many of its rarest starts a set of some size follows.

    If two sets share t of their m starts, they share one of the first m - t + 1 in any order
    that both follow. Where no set that could be near has more tokens than
    there are starts, nothing is sampled and near sets share threshold * m or more.
    """
    starts = min(size, runs)
    if size > threshold * runs:
        shared = shared_at_least(starts, threshold, (1 - recall) / PLACES)
    else:
        shared = math.ceil(threshold * starts - 1e-9)
    return starts - max(1, shared) + 1


def alike_from(threshold: float = THRESHOLD, recall: float = RECALL) -> float:
    """The part of their sketches from which two sets may be near."""
    return shared_at_least(SKETCH, threshold, (1 - recall) / PLACES) / SKETCH


def tokens_drawn(size: int, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many tokens of its sketch, first in an order that hangs on the path, extend a path of a set of some size.

    Two near sets go apart only if the first tokens of one of them are all not shared. Each is with a
    probability of 1 - threshold at most, and all extensions together lose no more than their part of the recall.
    Where sketches are whole sets, one token more than are not shared is enough.
    """
    loss = (1 - recall) / PLACES / max(1, depth) / 2
    drawn = min(size, SKETCH, math.ceil(math.log(loss) / math.log(1 - threshold)))
    if size <= threshold * SKETCH:
        drawn = min(drawn, size - math.ceil(threshold * size - 1e-9) + 1)
    return max(1, drawn)


def token_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per run of texts: different shingle hashes (below 2^63) ascending per text, and the places of the texts."""
    raw, offsets = common.text_buffers(texts)
    for a, b in common.chunks(offsets):
        part = raw[offsets[a] : offsets[b]]
        starts, ends, rows = common.word_spans(part, offsets[a : b + 1] - offsets[a])
        hashes, owner = common.shingle_hashes(common.span_hashes(part, starts, ends), rows, width)
        hashes = hashes >> np.uint64(1)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        if len(hashes):
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            hashes, owner = hashes[new], owner[new]
        yield hashes, np.searchsorted(owner, np.arange(b - a + 1))


def _firsts(values: np.ndarray, places: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.minimum(np.diff(places), most)
    ends = np.cumsum(sizes)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(places[:-1] - ends + sizes, sizes)
    return values[index], np.append(0, ends)


def _described(docs: DataFrame, width: int, runs: int = RUNS) -> DataFrame:
    """``set_id``, ``n`` and the smallest tokens of each row's set; a null set_id has no token."""

    def describe(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            keys, counts, roots, sketches = [], [], [], []
            for tokens, places in token_sets(texts, width):
                sizes = np.diff(places)
                sums = np.zeros(len(sizes), np.uint64)
                some = np.flatnonzero(sizes)
                if len(some):
                    sums[some] = np.add.reduceat(common.mix(tokens + np.uint64(0x51ED)), places[some])
                keys.append(pa.array((common.mix(sums + sizes.astype(np.uint64)) >> np.uint64(1)).astype(np.int64), mask=sizes == 0))
                counts.append(pa.array(sizes, pa.int32()))
                for out, most, kind in ((roots, runs, np.int64), (sketches, SKETCH, np.int32)):
                    values, ends = _firsts(tokens, places, most)
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int64).astype(kind))))
            yield pa.StructArray.from_arrays(
                [pa.concat_arrays(x) for x in (keys, counts, roots, sketches)], names=["set_id", "n", "roots", "sketch"]
            )

    described_by = F.arrow_udf(describe, "set_id bigint, n int, roots array<bigint>, sketch array<int>")
    return docs.withColumn("s", described_by("text")).select("doc_id", "text_key", "s.*")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for undirected edges ``a, b``; the component is its smallest node.

    A node with smaller neighbours only hangs on the smallest of them and is set aside: what it tells is that its
    neighbours belong together. Among the rest, large-star and small-star steps in turn, each a minimum per node with
    partial sums in the tasks and a join; each round's edges are a written table.
    """
    edges = common.written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges"
    )
    least = common.written(edges.groupBy("u").agg(F.min("v").alias("m")), "component-least")
    inner = edges.select(F.col("v").alias("u")).distinct()
    apart = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    core = _starred(apart.unionByName(least.join(inner, "u", "left_semi").withColumnRenamed("m", "v")).distinct())
    core = common.written(core, "component-core")
    hung = least.join(inner, "u", "left_anti").join(core.withColumnRenamed("node", "m"), "m", "left").select(
        F.col("u").alias("node"), "m", F.coalesce("component", "m").alias("component")
    )
    hung = common.written(hung, "component-hung")
    # A node that only others hang on is in no edge of the core, and a component of its own.
    tops = hung.where("m = component").select(F.col("m").alias("node"), "component").distinct().join(core, "node", "left_anti")
    return core.unionByName(hung.drop("m")).unionByName(tops)


def _starred(edges: DataFrame) -> DataFrame:
    """``node, component`` for different edges ``u > v``."""
    edges = common.written(edges, "component-edges")
    size = edges.count()
    if not size:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*").where("u <> v").distinct()
        )
        edges = common.written(small, "component-edges")
        count, after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, after) == (size, mark):
            break
        size, mark = count, after
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _first_paths(sets: DataFrame, recall: float, threshold: float) -> DataFrame:
    """``set_id, weight, node`` of the starts that each set follows, but for those it is alone on.

    The weight of a set tells how many others it meets on its starts.
    """
    starts = sets.select("set_id", F.explode("roots").alias("node"))
    met = starts.groupBy("node").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    followed = F.array(*[F.lit(starts_followed(n, RUNS, threshold, recall)) for n in range(RUNS + 1)])
    # Starts on which a set is alone are its rarest. At most RUNS rows meet per set.
    rarest = starts.join(met, "node").groupBy("set_id").agg(
        F.sort_array(F.collect_list(F.struct("met", "node"))).alias("shared"), F.sum("met").alias("weight")
    )
    number = F.get(followed, F.least("n", F.lit(RUNS)))
    alone = F.least("n", F.lit(RUNS)) - F.size("shared")
    return (
        rarest.join(sets.select("set_id", "n"), "set_id")
        .where(number > alone)
        .select("set_id", "weight", F.explode(F.slice("shared", F.lit(1), F.greatest(number - alone, F.lit(1)))).alias("x"))
        .select("set_id", "weight", "x.node")
    )


def _candidates(sets: DataFrame, *, recall: float, threshold: float, depth: int) -> DataFrame:
    """Pairs ``a, b`` of sets that may be near: edges that keep each near pair in one group."""
    paths = common.written(_first_paths(sets, recall, threshold), "paths")
    sketches = sets.select("set_id", "n", "sketch")
    maybe = alike_from(threshold, recall)
    number = F.get(
        F.array(*[F.lit(tokens_drawn(n, depth, threshold, recall)) for n in range(SKETCH + 1)]), F.least("n", F.lit(SKETCH))
    )
    edges = []
    for level in range(depth + 1):
        # Sets alone on a path are gone after this aggregate. The one that a bucket is compared with meets most others: it
        # lies in the middle of a group of near copies, if there is one.
        met = common.written(
            paths.groupBy("node").agg(
                F.count(F.lit(1)).alias("met"), F.min("set_id").alias("a"), F.max("set_id").alias("b"),
                F.max(F.struct("weight", "set_id"))["set_id"].alias("rep"),
            ).where("met > 1"),
            "paths-met",
        )
        members = common.written(
            paths.join(met.where("met > 2").select("node", "rep"), "node")
            .where("set_id <> rep")
            .select("node", "rep", "set_id", "weight"),
            "paths-crowded",
        )
        pairs = met.where("met = 2 AND a <> b").select(F.col("a").alias("rep"), F.col("b").alias("set_id"))
        if level == depth:
            # Sets that shared so many sampled tokens stay together for the exact comparison.
            edges.append(members.select(F.col("rep").alias("a"), F.col("set_id").alias("b")))
        else:
            pairs = pairs.unionByName(members.select("rep", "set_id"))
        pairs = common.written(pairs.distinct(), "paths-pairs")
        active = pairs.select("set_id").unionByName(pairs.select(F.col("rep").alias("set_id"))).distinct()
        sketches = common.written(sketches.join(active, "set_id", "left_semi"), "paths-sketches")
        compared = (
            pairs.join(sketches, "set_id")
            .join(sketches.select(F.col("set_id").alias("rep"), F.col("n").alias("rep_n"), F.col("sketch").alias("rep_sketch")), "rep")
            .select(
                "rep", "set_id", F.size(F.array_intersect("sketch", "rep_sketch")).alias("shared"), F.least("n", F.lit(SKETCH)).alias("size"),
                F.least(F.lit(SKETCH), F.greatest("n", "rep_n")).alias("whole"),
            )
        )
        alike = common.written(compared.withColumn("unlike", F.col("shared") < maybe * F.col("whole")), "paths-alike")
        edges.append(alike.where("NOT unlike").select(F.col("rep").alias("a"), F.col("set_id").alias("b")))
        if level == depth:
            break
        judged = members.join(alike, ["rep", "set_id"])
        # Sets that are half alike join the group of those that are alike, to be compared exactly with all of it, unless they are
        # more: that leaves the bucket settled, and at most doubles what is compared.
        close = F.col("unlike") & (F.col("shared") >= CLOSE * F.col("whole"))
        buckets = judged.groupBy("node").agg(
            (FEW * F.count_if(close) <= F.count_if(~F.col("unlike"))).alias("joins"),
            F.max(F.when(F.col("unlike"), F.col("shared"))).alias("most"),
            F.max(F.when(F.col("unlike") & ~close, F.col("shared"))).alias("most_far"),
        )
        buckets = buckets.withColumn("most", F.when(F.col("joins"), F.col("most_far")).otherwise(F.col("most"))).drop("most_far")
        judged = common.written(
            judged.join(buckets, "node").select(
                "node", "rep", "set_id", "weight", "shared", "size", "most", (F.col("unlike") & ~(close & F.col("joins"))).alias("apart"),
                (close & F.col("joins")).alias("joined"),
            ),
            "paths-judged",
        )
        edges.append(judged.where("joined").select(F.col("rep").alias("a"), F.col("set_id").alias("b")))
        # Near sets share a part of maybe of their sketches. Of a set that has so much of its sketch from the one compared with
        # that any near set would share more with that one than what is apart in the bucket does, none of that is near.
        far = F.col("shared") - F.col("size") + F.ceil(maybe * F.col("size") - 1e-9) > F.col("most")
        ongoing = judged.where(F.col("most").isNotNull() & (F.col("apart") | ~far)).select("node", "rep", "set_id", "weight")
        if ongoing.isEmpty():
            break
        drawn = F.slice(F.array_sort(F.transform("sketch", lambda t: F.xxhash64("node", t))), F.lit(1), number)
        paths = common.written(ongoing.join(sketches, "set_id").select("set_id", "weight", F.explode(drawn).alias("node")), "paths")
    out = edges[0]
    for part in edges[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- brute force in tiles


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, token, counts = np.unique(every, return_inverse=True, return_counts=True)
    # Only tokens on both sides count.
    on_left = np.bincount(token[owner < len(left)], minlength=len(counts)) > 0
    on_right = np.bincount(token[owner >= len(left)], minlength=len(counts)) > 0
    both = on_left & on_right
    number = np.cumsum(both) - 1
    some = both[token]
    token, owner, width = number[token[some]], owner[some], int(both.sum())
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    step = 2048
    for at in range(0, width, step):
        a, b = np.searchsorted(token, (at, at + step))
        matrix = np.zeros((len(left) + len(right), min(step, width - at)), np.float32)
        matrix[owner[a:b], token[a:b] - at] = 1
        out += matrix[: len(left)] @ matrix[len(left) :].T
    return out.astype(np.int64)


def _near(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    shared = _overlaps(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return shared >= threshold * (sizes - shared) - 1e-9


def _roots(near: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component."""
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _compared(rows: DataFrame, threshold: float, width: int) -> DataFrame:
    """From ``component, i, j, tile, set_id, copies, text``: links of each set per tile pair, and roots.

    Rows ``set_id, root, links, whole``: ``root`` is the smallest set of its part of the tile pair's graph,
    ``whole`` says that the component is one tile, so that the root is final.
    """
    kind = "set_id bigint, root bigint, links bigint, whole boolean"
    schema = pa.schema([("set_id", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("whole", pa.bool_())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups_of(batches, ["component", "i", "j"]):
            ids, first = np.unique(group.column("set_id").to_numpy(), return_index=True)
            copies, tile = group.column("copies").to_numpy()[first], group.column("tile").to_numpy()[first]
            offsets = group.column("tokens").combine_chunks().offsets.to_numpy()
            flat = group.column("tokens").combine_chunks().values.to_numpy()
            sets = [flat[offsets[k] : offsets[k + 1]] for k in first.tolist()]
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            m = len(ids)
            near = np.zeros((m, m), bool)
            if i == j:
                near = _near(sets, sets, threshold)
                np.fill_diagonal(near, False)
            else:
                left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
                if len(left) and len(right):
                    part = _near([sets[k] for k in left], [sets[k] for k in right], threshold)
                    near[np.ix_(left, right)] = part
                    near[np.ix_(right, left)] = part.T
            root = _roots(near)
            links = near @ copies
            whole = bool(group.column("whole")[0].as_py())
            yield common.batch_of(
                {"set_id": ids, "root": ids[root], "links": links, "whole": np.full(m, whole)}, schema
            )

    def tokens_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            parts = []
            for tokens, places in token_sets(texts, width):
                parts.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(tokens.astype(np.int64))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    tokens = F.arrow_udf(tokens_of, "array<bigint>")
    tiles = F.col("tiles")
    # A set of tile t meets the tiles up to t as their partner, and those from t on as the first.
    pairs = F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda k: F.struct(F.least(k, F.col("tile")).alias("i"), F.greatest(k, F.col("tile")).alias("j")),
    )
    return (
        rows.withColumn("tokens", tokens("text"))
        .drop("text")
        .withColumn("p", F.explode(pairs))
        .select("component", "p.i", "p.j", "tile", "set_id", "copies", "tokens", (tiles == 1).alias("whole"))
        .repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(compare, kind)
    )


def near_classes(
    docs: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): doc_id, class_id, copy_id, n_links, and keys.

    Links join rows whose sets of ``width``-word shingles have a Jaccard similarity of at least ``threshold``;
    ``n_links`` counts the other rows linked to a row, copies included. ``class_id`` is the
    smallest doc_id among rows connected by links, ``copy_id`` that among rows with an equal set.
    A text of fewer words, but at least one, is one shingle. Null texts and texts without words are in
    no link and classes of their own. A null doc_id is never the smallest unless alone. Repeated rows are copies. No rows: no rows. Other columns
    are ignored. Sets are told apart by 63-bit hashes. ``class_key`` (null for texts without
    words) names the class also where no doc_id does, ``text_key`` hashes the text.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("text_key", F.xxhash64("text"))
    described = common.written(_described(rows, width).withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    filled = described.where("set_id IS NOT NULL")
    # One text stands for each set: that of its smallest doc_id.
    copies = common.written(
        filled.groupBy("set_id").agg(
            F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("copy_id"),
            F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text_key", "row")).alias("first"),
        ),
        "shingle-copies",
    )
    sets = common.written(
        filled.join(copies.select(F.col("first.row").alias("row")), "row", "left_semi").select("set_id", "n", "roots", "sketch"),
        "shingle-distinct",
    )
    groups = components(_candidates(sets, recall=recall, threshold=threshold, depth=depth))
    groups = groups.select(F.col("node").alias("set_id"), "component")
    sized = groups.join(sets.select("set_id", "n"), "set_id")
    tiles = sized.groupBy("component").agg(
        F.greatest(F.ceil(F.sum("n") / TILE_TOKENS), F.ceil(F.count(F.lit(1)) / TILE_SETS)).cast("int").alias("tiles")
    )
    members = common.written(
        groups.join(tiles, "component")
        .join(copies.select("set_id", "copies", "first"), "set_id")
        .select(
            "component", "tiles", F.pmod(F.xxhash64("set_id"), "tiles").cast("int").alias("tile"), "set_id", "copies",
            F.col("first.doc_id").alias("key"), F.col("first.text_key").alias("text_key"),
        ),
        "near-members",
    )
    texts = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "text_key", "text")
    compared = common.written(_compared(texts.join(members.hint("merge"), ["key", "text_key"]), threshold, width), "near-links")
    links = compared.groupBy("set_id").agg(F.sum("links").alias("links"))
    found = compared.where("whole").select("set_id", F.col("root").alias("class"))
    parts = compared.where("NOT whole AND set_id <> root").select(F.col("set_id").alias("a"), F.col("root").alias("b"))
    if not parts.isEmpty():
        found = found.unionByName(components(parts).select(F.col("node").alias("set_id"), F.col("component").alias("class")))
    by_set = (
        copies.select("set_id", "copies", "copy_id")
        .join(links, "set_id", "left")
        .join(found, "set_id", "left")
        .withColumn("class", F.coalesce("class", "set_id"))
    )
    by_set = common.written(by_set, "near-sets")
    names = by_set.groupBy("class").agg(F.min("copy_id").alias("class_id"))
    by_set = by_set.join(names, "class").select(
        "set_id", F.col("class").alias("class_key"), "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return described.select("doc_id", "text_key", "set_id").join(by_set, "set_id", "left").select(
        "doc_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "class_key",
        "text_key",
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Of each class of ``near_classes`` the row with the smallest doc_id, with the columns it has.

    Rows that repeat it are left out too. Texts without words are in no class and all stay.
    """
    rows = near_classes(docs, **options)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    first = rows.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct(key.alias("key"), "text_key")).alias("x"))
    name, mark = common.spare(docs, "row_key"), common.spare(docs, "row_text")
    named = docs.withColumns({name: key, mark: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    chosen = first.select(F.col("x.key").alias(name), F.col("x.text_key").alias(mark))
    wordless = named.where(~F.coalesce(F.col("text"), F.lit("")).rlike(common.WORD))
    kept = named.join(chosen, [name, mark], "left_semi").dropDuplicates([name, mark])
    return kept.unionByName(wordless).select(*[F.col(f"`{c}`") for c in docs.columns])
