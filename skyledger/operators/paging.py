"""Keyset pages: rows after a cursor, in a fixed order, with a has-more flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: Sequence[str], descending: bool) -> list:
    return [F.col(k).desc() if descending else F.col(k).asc() for k in keys]


def check_limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"page limit must be between 1 and {most}")
    return limit


def after_cursor(df: DataFrame, keys: Sequence[str], cursor: Sequence | None, descending: bool = False) -> DataFrame:
    """Rows behind the cursor values, compared as one row value."""
    if cursor is None:
        return df
    types = dict(df.dtypes)
    position = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, cursor, strict=True)])
    here = F.struct(*[F.col(k) for k in keys])
    return df.where(here < position if descending else here > position)


def page(
    df: DataFrame, keys: Sequence[str], limit: int, cursor: Sequence | None = None, *,
    descending: bool = False, most: int = 500,
) -> DataFrame:
    """One page of the whole table; one row more than the page decides has_more."""
    check_limit(limit, most)
    rows = after_cursor(df, keys, cursor, descending).orderBy(*_order(keys, descending)).limit(limit + 1)
    return _mark(rows, [], keys, limit, descending)


def first_pages(
    df: DataFrame, by: Sequence[str], keys: Sequence[str], limit: int, *,
    descending: bool = False, most: int = 500, cursors: DataFrame | None = None,
) -> DataFrame:
    """The first page of every group, or the page behind each group's cursor.

    ``cursors`` has one row per group that goes on, with the ``by`` and ``keys`` columns of
    the last row that was seen (``page_ends``); groups without one have no page.
    The row-number bound lets Spark cut every group on the map side, so a large
    group sends at most ``limit + 1`` rows per input task.
    """
    check_limit(limit, most)
    if cursors is not None:
        seen = cursors.select(*by, F.struct(*keys).alias("__cursor"))
        here = F.struct(*keys)
        behind = here < F.col("__cursor") if descending else here > F.col("__cursor")
        df = df.join(seen, list(by)).where(behind).drop("__cursor")
    order = Window.partitionBy(*by).orderBy(*_order(keys, descending))
    rows = df.withColumn("page_row", F.row_number().over(order)).where(F.col("page_row") <= limit + 1)
    return _mark(rows.drop("page_row"), by, keys, limit, descending)


def _mark(rows: DataFrame, by: Sequence[str], keys: Sequence[str], limit: int, descending: bool) -> DataFrame:
    group = [F.col(k) for k in by] or [F.lit(1)]
    order = Window.partitionBy(*group).orderBy(*_order(keys, descending))
    everything = Window.partitionBy(*group)
    return (
        rows.withColumn("page_row", F.row_number().over(order).cast("bigint"))
        .withColumn("has_more", F.max("page_row").over(everything) > limit)
        .where(F.col("page_row") <= limit)
    )


def page_ends(pages: DataFrame, by: Sequence[str], keys: Sequence[str], *, descending: bool = False) -> DataFrame:
    """The cursor of every group whose page is not its last."""
    end = (F.min if descending else F.max)(F.struct(*keys)).alias("__end")
    return pages.where("has_more").groupBy(*by).agg(end).select(*by, "__end.*")


def newest(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row with the greatest order values of every group, by aggregation."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("__best")
    return df.groupBy(*by).agg(best).select(*by, "__best.*")


def least(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row with the least order values of every group, by aggregation."""
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("__best")
    return df.groupBy(*by).agg(best).select(*by, "__best.*")
