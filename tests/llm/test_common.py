from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyledger.llm import common


def test_words_are_those_of_the_pattern():
    texts = ["", " a  b\n", "x", None, "\x0bé\x1c☃\t  q", "  ", "last"]
    raw, offsets = common.text_buffers(pa.array(texts))
    starts, ends, rows = common.word_spans(raw, offsets)
    for k, text in enumerate(texts):
        mine = [raw[a:b].tobytes().decode() for a, b in zip(starts[rows[k] : rows[k + 1]], ends[rows[k] : rows[k + 1]])]
        assert mine == re.findall(common.WORD, text or "")


def test_hashes_tell_spans_apart_and_find_equal_ones():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abé☃", k=rng.randint(1, 6))) for _ in range(50)) for _ in range(300)]
    raw, offsets = common.text_buffers(pa.array(texts))
    starts, ends, _ = common.word_spans(raw, offsets)
    words = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
    hashes = common.span_hashes(raw, starts, ends).tolist()
    assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))


def test_shingles_of_rows():
    words = np.arange(10, dtype=np.uint64)
    hashes, owner = common.shingle_hashes(words, np.array([0, 0, 3, 10]), 5)
    assert owner.tolist().count(2) == 3 and owner.tolist().count(1) == 1 and owner.tolist().count(0) == 0
    assert len(set(hashes.tolist())) == 4


def test_shards_cover_ranges_and_ignore_order(spark):
    rng = random.Random(2)
    keys = [rng.choice([rng.randint(0, 50), rng.randint(-(10**12), 10**12)]) for _ in range(500)] + [None] * 5
    df = spark.createDataFrame([(k, rng.randint(1, 100)) for k in keys], "k long, w long")
    cuts = common.range_cuts(df, "k", F.col("w"), 2000)
    assert cuts == common.range_cuts(df.orderBy("w").repartition(7), "k", F.col("w"), 2000)
    assert cuts == sorted(set(cuts)) and 5 < len(cuts) < 60
    for k, shard in df.select("k", common.shard_of("k", cuts)).collect():
        assert shard == (0 if k is None else int(np.searchsorted(cuts, k, side="right")))
    sizes = df.groupBy(common.shard_of("k", cuts)).agg(F.sum("w")).collect()
    assert max(s[1] for s in sizes) < 2500
    assert common.range_cuts(df.limit(0), "k", F.col("w"), 10) == []


def test_dense_and_lumpy_ranges_are_divided_to_the_end(spark):
    # More intervals exceed the target at once than a round has buckets.
    dense = spark.range(6000).selectExpr("id AS k", "10L AS w")
    cuts = common.range_cuts(dense, "k", F.col("w"), 20, buckets=64)
    assert len(cuts) == 2999 and max(b - a for a, b in zip(cuts, cuts[1:])) == 2
    lumpy = spark.range(4000).selectExpr("CASE WHEN id < 2000 THEN id * 3 WHEN id < 3900 THEN 1000000000000 + id ELSE -id * 1000000007 END AS k", "1L AS w")
    cuts = common.range_cuts(lumpy, "k", F.col("w"), 10, buckets=16)
    sizes = lumpy.groupBy(common.shard_of("k", cuts)).agg(F.sum("w")).collect()
    assert max(s[1] for s in sizes) <= 10 and len(cuts) < 850
    one = spark.range(50).selectExpr("7L AS k", "1L AS w")
    assert common.range_cuts(one, "k", F.col("w"), 3) == []


def test_groups_come_whole():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([1, 1, 2], [], [2, 2], [3], [3, 4])]
    sizes = [(t.column("k")[0].as_py(), t.num_rows) for t in common.groups_of(iter(batches), ["k"])]
    assert sizes == [(1, 2), (2, 3), (3, 2), (4, 1)]
