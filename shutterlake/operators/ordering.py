"""Exact running positions over data too large, or too skewed, for one window.

A window needs all rows of its partition in one task, which fails when one key
(or no key at all) covers the table. Here the rows are range-partitioned by key
*and* order, so that a hot key is cut into several slices, each slice is
numbered on its own, and the few per-slice totals are added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.operators.skew import hot_keys, split_join
from shutterlake.session import materialize

SLICE = "_slice"


def sorted_slices(df: DataFrame, keys: Sequence[str | Column], slices: int | None = None) -> DataFrame:
    """Range-partition by the keys and store the partition number as `_slice`.

    Slice numbers rise with the key order. The result is written out because
    range bounds come from a sample and must not be drawn twice. With a number of
    slices Spark does not join small ones, so their size is the caller's.
    """
    cut = df.repartitionByRange(*keys) if slices is None else df.repartitionByRange(slices, *keys)
    return materialize(cut.withColumn(SLICE, F.spark_partition_id()))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys with a table of at most one row per slice."""
    renamed = small.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return df.join(F.broadcast(renamed), cond, "left").drop(*[f"_on_{k}" for k in keys])


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
) -> DataFrame:
    """`row_number` from 1 within each group, safe for groups of any size.

    `order` must be total within a group. The carry table has a row only for a
    group that continues from an earlier slice, so at most one per slice.
    """
    cut = sorted_slices(df, [*[F.col(g) for g in group], *order])
    local = W.partitionBy(SLICE, *group).orderBy(*order)
    counts = cut.groupBy(SLICE, *group).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = before.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        counts.withColumn("_before", F.sum("_n").over(before))
        .where(F.col("_before").isNotNull())
        .drop("_n")
    )
    numbered = attach(
        cut.withColumn("_local", F.row_number().over(local)), carry, [SLICE, *group]
    )
    position = F.col("_local") + F.coalesce("_before", F.lit(0))
    return numbered.select(*df.columns, position.cast("long").alias(name))


def exact_quantile(
    df: DataFrame, group: Sequence[str], value: str, q: float, name: str, tie: str
) -> DataFrame:
    """Linear-interpolated quantile per group without gathering the group.

    Rows are numbered by value, the two rows around the wanted rank are picked
    and averaged; only counts and those two rows meet per group.
    """
    ranked = number_rows(
        df.select(*group, value, tie), group, [F.col(value).asc(), F.col(tie).asc()], "_rank"
    )
    ranked = materialize(ranked)
    sizes = materialize(ranked.groupBy(*group).agg(F.max("_rank").alias("_n")))
    at = (F.col("_n") - 1) * F.lit(q)
    low, frac = F.floor(at), at - F.floor(at)
    picked = split_join(ranked, sizes, group, hot_keys(sizes, group, "_n")).where(
        (F.col("_rank") == low + 1) | (F.col("_rank") == F.least(low + 2, F.col("_n")))
    )
    lo = F.max(F.when(F.col("_rank") == low + 1, F.col(value)))
    hi = F.max(F.when(F.col("_rank") == F.least(low + 2, F.col("_n")), F.col(value)))
    return picked.groupBy(*group).agg(
        (lo + (hi - lo) * F.max(frac)).alias(name), F.max("_n").alias("n")
    )
