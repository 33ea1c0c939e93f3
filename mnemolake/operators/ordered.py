"""Running totals, row numbers and previous rows that survive one very large group.

A plain window puts a whole group in one task. That is right while every group is small, which is
checked first (one count over the keys). With a larger group each group is cut into blocks of its
leading order column (``order[0]`` must be a non-negative integer or null); a small per-block summary carries
totals or the last row from block to block, and the windows run inside (group, block). Groups of any
size then spread over the cluster and the outcome is the same. Missing keys form a group of their own on
both routes. Group and block are one column, which the summary is joined by and the windows run over, so whole rows
are dealt out once and not once for each.

``small`` hands on what is already known: keys refined from checked ones need no second count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 12
GROUP_ROWS = 1 << 14


def groups_are_small(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """Whether no group of ``keys`` has more rows than one task should window over."""
    limit = GROUP_ROWS if limit is None else limit
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return largest is None or largest <= limit


def _blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], span: int) -> DataFrame:
    """Rows with ``_block``: their group and block. A struct is never null, and missing fields are equal to each other."""
    group = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    return df.withColumn("_block", F.struct(*group, F.floor(F.col(order[0]) / F.lit(span)).alias("block")))


def _groups(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"_block.k{i}") for i in range(len(keys))]


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, *, span: int = SPAN, small: bool | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running total of ``value`` along ``order`` inside ``keys``.

    Columns of ``known``, which has a row per group at most, are added to the rows on the way (null where it has none).
    """
    keys = list(keys)
    if groups_are_small(df, keys) if small is None else small:
        df = df if known is None else df.join(known, keys, "left")
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.coalesce(F.sum(value).over(whole), F.lit(0)))
    blocked = _blocked(df.withColumn("_value", value), keys, order, span)
    earlier = Window.partitionBy(*_groups(keys)).orderBy("_block.block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocked.groupBy("_block")
        .agg(F.sum("_value").alias("_total"))
        .select("_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carry"))
    )
    if known is not None:
        named = carry.select("*", *[g.alias(k) for g, k in zip(_groups(keys), keys)])
        carry = named.join(known, keys, "left").drop(*keys)
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(carry, "_block")
        .withColumn(out, F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_carry"))
        .drop("_block", "_value", "_carry")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, *, start: int = 0, span: int = SPAN, small: bool | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Dense row numbers along ``order`` inside ``keys``, from ``start``; ``known`` as in ``running_sum``."""
    ranked = running_sum(df, keys, order, F.lit(1).cast("bigint"), out, span=span, small=small, known=known)
    return ranked.withColumn(out, F.col(out) + F.lit(start - 1))


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str, *, span: int = SPAN, small: bool | None = None
) -> DataFrame:
    """Struct ``out`` of ``columns`` as they stood one row earlier (null on a group's first row)."""
    if groups_are_small(df, keys) if small is None else small:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.lag(F.struct(*columns)).over(whole))
    blocked = _blocked(df.withColumn("_row", F.struct(*columns)), keys, order, span)
    carry = (
        blocked.groupBy("_block")
        .agg(F.max_by("_row", F.struct(*order)).alias("_last"))
        .select("_block", F.lag("_last").over(Window.partitionBy(*_groups(keys)).orderBy("_block.block")).alias("_carry"))
    )
    inside = Window.partitionBy("_block").orderBy(*order)
    return (
        blocked.join(carry, "_block")
        .withColumn(out, F.coalesce(F.lag("_row").over(inside), F.col("_carry")))
        .drop("_block", "_row", "_carry")
    )
