"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies. Two documents meet and
words move from one to the other, up or down at random so that both keep their expectation
and their sum of words stays exact, until one number of copies is whole. That document is
decided, the other one meets the next. One fractional document is left per group; the left ones
of all groups meet again, level by level, until each source has one, which is rounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm import common
from skyledger.skew import join_checked

#: Documents of a group on the first level, and groups that meet on the next one.
GROUP = 2048
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: A document with more than this part of the words after it is drawn first.
LARGE = 0.02
#: Stands for a null key inside groups, as pandas has no null integers.
NULL_KEY = -(1 << 63)


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(common.WORD)).cast("bigint")


def source_targets(
    sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, source_size, n, target`` from rows ``source, size``.

    Sources in code point order, null last, have the weights in turn. All targets together
    are ``share`` of all sizes. A target stops at ``most`` times its source's size, and what is above goes
    to the others by weight, again and again until none is above. The table has one row per
    source; only the totals of each round reach the driver.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    table = common.written(
        by_source.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)), "mixing-sources"
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    capped = F.col("source_size") * F.lit(most)
    level = 0.0
    while True:
        # The level only rises, and each round stops at least one more source.
        stopped = F.col("weight") * F.lit(level) >= capped
        held, free = table.agg(
            F.sum(F.when(stopped, capped).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))
        ).first()
        if not free:
            break
        higher = (share * total - held) / free
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.select(
        "source", "source_size", "n", F.least(F.col("weight") * F.lit(level), capped.cast("double")).alias("target")
    )


def _largest_first(sizes: np.ndarray, odds: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Draw the documents, largest first, that hold a notable part of their source's words.

    Such a document would be left over at the end and miss the target by up to half its
    words. What the draw gives or takes is moved to or from all documents after it, in
    proportion to the room they have, so the expected sum of words stays.
    """
    odds = odds.copy()
    for k in range(len(sizes) - 1):
        rest, p = slice(k + 1, None), odds[k]
        if sizes[k] <= LARGE * sizes[rest].sum():
            break
        if p <= 1e-12 or p >= 1 - 1e-12:
            continue
        room = float((sizes[rest] * (1 - odds[rest])).sum())
        held = float((sizes[rest] * odds[rest]).sum())
        up = draws[k] < p
        if up and (1 - p) * sizes[k] > held:
            up = False
        if not up and p * sizes[k] > room:
            up = (1 - p) * sizes[k] <= held
            if not up:
                break
        if up:
            odds[rest] -= odds[rest] * ((1 - p) * sizes[k] / held)
        else:
            odds[rest] += (1 - odds[rest]) * (p * sizes[k] / room)
        odds[k] = float(up)
    return odds


def _duels(group: pd.DataFrame) -> pd.DataFrame:
    """Decide all documents of a group but one; ``copies`` is whole where ``open`` is false."""
    group = group.sort_values(["size", "u", "row"], ascending=[False, True, True], kind="stable")
    sizes, odds, draws = group["size"].tolist(), group["copies"].tolist(), group["u"].tolist()
    if group["alone"].iloc[0]:
        odds = _largest_first(np.array(sizes, float), np.array(odds), group["u"].to_numpy()).tolist()
    carry = None
    for k in range(len(sizes)):
        if odds[k] <= 1e-12 or odds[k] >= 1 - 1e-12:
            odds[k] = float(round(odds[k]))
            continue
        if carry is None:
            carry = k
            continue
        s, t, p, q = sizes[carry], sizes[k], odds[carry], odds[k]
        to_carry = min((1 - p) * s, q * t)
        to_next = min((1 - q) * t, p * s)
        if draws[k] * (to_carry + to_next) < to_next:
            p, q = p + to_carry / s, q - to_carry / t
        else:
            p, q = p - to_next / s, q + to_next / t
        odds[carry], odds[k] = p, q
        left = [j for j in (carry, k) if 1e-9 < odds[j] < 1 - 1e-9]
        for j in (carry, k):
            if j not in left:
                odds[j] = float(round(odds[j]))
        carry = left[0] if left else None
    group["copies"] = odds
    group["open"] = False
    if carry is not None:
        group.iloc[carry, group.columns.get_loc("open")] = True
    return group


def _large_limits(sizes: DataFrame, side: DataFrame) -> DataFrame | None:
    """``name, rest, limit``: words of a source in documents up to the limit; those above it are drawn first.

    ``sizes`` has ``name, size``. A document is large if it holds more than ``LARGE`` of the words of those that
    are not larger ones; each round takes those out that are, 1 / LARGE + 1 per source at most, until none is. None: no source has one.
    """
    part = LARGE / (1 + LARGE)
    limits = common.written(side.select("name", F.col("source_size").alias("rest"), (F.col("source_size") * part).alias("limit")), "mixing-limits")
    first = True
    while True:
        kept = F.when(F.col("size") <= F.col("limit"), F.col("size")).otherwise(0)
        after = (
            join_checked(sizes, limits, ["name"]).groupBy("name")
            .agg(F.sum(kept).alias("left"), F.first("rest").alias("rest"), F.first("limit").alias("limit"))
        )
        after = common.written(after, "mixing-limits")
        if after.where("left < rest").isEmpty():
            return None if first else after.select("name", "rest", "limit")
        limits = common.written(after.select("name", F.col("left").alias("rest"), (F.col("left") * part).alias("limit")), "mixing-limits")
        first = False


def _drawn(group: pd.DataFrame) -> pd.DataFrame:
    """Draw a source's large documents; a last row without size tells the number of copies of the rest."""
    group = group.sort_values(["size", "u", "row"], ascending=[False, True, True], kind="stable")
    rest, rate = float(group["rest"].iloc[0]), float(group["copies"].iloc[0])
    odds = _largest_first(
        np.append(group["size"].to_numpy(float), rest), np.append(group["copies"].to_numpy(float), rate), np.append(group["u"].to_numpy(), 0.0)
    )
    last = group.iloc[[-1]].copy()
    last["tail"] = True
    last["copies"] = odds[-1]
    group["copies"] = odds[:-1]
    return pd.concat([group, last])


def _large_drawn(rows: DataFrame, side: DataFrame) -> DataFrame:
    """``rows`` of sources of many groups with their large documents drawn, and the rest at the rate that is left."""
    many = side.where("source_n > `group`").drop("group")
    limits = _large_limits(rows.where("NOT alone").select("name", "size"), many)
    if limits is None:
        return rows
    marked = join_checked(rows.where("NOT alone"), limits, ["name"])
    columns = rows.columns
    large = marked.where("size > limit").select(*columns, "rest", F.lit(False).alias("tail"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in large.schema.fields)
    drawn = common.written(large.groupBy("name").applyInPandas(_drawn, kind), "mixing-large")
    rates = drawn.where("tail").select("name", F.col("copies").alias("rate"))
    # Sources without a large document keep their rate.
    small = join_checked(
        marked.where("size <= limit").select(*columns),
        limits.select("name").join(rates, "name", "left"), ["name"],
    ).withColumn("copies", F.when(F.col("size") > 0, F.coalesce("rate", "copies")).otherwise(F.col("copies")))
    return (
        rows.where("alone")
        .unionByName(drawn.where("NOT tail").select(*columns))
        .unionByName(small.select(*columns))
    )


def mix(docs: DataFrame, key: str, *, group: int = GROUP, seed: int = 9, **targets) -> DataFrame:
    """How often the mix takes each row of ``docs`` (``source``, ``text`` and an integer ``key``).

    Returns ``key, size, source_size, target, copies``, copies being whole and at most 2. A
    null text has size 0; rows without a word are taken as often as their source's whole
    part says and count for nothing. A null source is a source. Equal rows are rounded each
    for itself. No rows: no rows. Draws and groups follow from hashes of the row's texts and
    ids, so a rerun, also with other partitions, decides alike as long as ``key`` stays.
    A source's taken words miss its target by half of one document at most; large documents are drawn
    first where the others can make up for them, so that document is a small one. Rows that are equal in key and text share a group.
    """
    sizes = common.written(
        docs.select(
            F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_KEY)).alias("row"), F.col("source").cast("string").alias("source"), word_count().alias("size"),
            F.xxhash64(F.col(key), F.col("text"), F.lit(seed)).alias("h"),
        ),
        "mixing-sizes",
    )
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sources = common.written(source_targets(sizes, **targets), "mixing-targets")
    side = sources.withColumn("name", named).drop("source").withColumnRenamed("n", "source_n")
    most = side.agg(F.max("source_n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + F.lit(1e-12))
    rows = (
        join_checked(sizes.withColumn("name", named).drop("source"), side, ["name"])
        .withColumn("whole", whole)
        .withColumn("copies", F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0))
        .withColumn("u", F.shiftrightunsigned(F.col("h"), 11).cast("double") / F.lit(float(1 << 53)))
        .withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.col("source_n") / group)).cast("bigint"))
        .withColumn("alone", F.col("source_n") <= group)
        .select("row", "name", "size", "source_size", "target", "whole", "copies", "u", "bucket", "alone")
    )
    rows = _large_drawn(common.written(rows, "mixing-odds"), side.withColumn("group", F.lit(group)))
    kind = (
        "row bigint, name string, size bigint, source_size bigint, target double, whole bigint, copies double, "
        "u double, bucket bigint, alone boolean, open boolean"
    )
    decided, buckets = [], -(-most // group)
    level = rows
    while True:
        level = common.written(level.groupBy("name", "bucket").applyInPandas(_duels, kind), "mixing-level")
        decided.append(level.where("NOT open"))
        left = level.where("open")
        if buckets <= 1:
            decided.append(left.withColumn("copies", F.round("copies")))
            break
        buckets = -(-buckets // group)
        level = left.withColumns(
            {"bucket": F.floor(F.col("bucket") / group).cast("bigint"), "alone": F.lit(False)}
        ).drop("open")
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select(
        F.nullif(F.col("row"), F.lit(NULL_KEY)).alias(key), "size", "source_size", "target",
        (F.col("whole") + F.col("copies").cast("bigint")).alias("copies"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns they have.

    The rows are written once with a number each, so that numbers and rows agree whatever is
    computed again.
    """
    number, copies = common.spare(docs, "row_number"), common.spare(docs, "copies")
    rows = common.written(docs.withColumn(number, F.monotonically_increasing_id()), "mixing-rows")
    taken = mix(rows, number, **options).where("copies > 0").select(F.col(number), F.col("copies").alias(copies))
    # A merge join at every size: what is taken grows with the documents, so it is never broadcast.
    return (
        rows.join(taken.hint("merge"), number)
        .withColumn(copies, F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
