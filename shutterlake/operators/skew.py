"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import materialize

# A key is hot when it has more than this share of the rows, so there are fewer
# than 1000 hot keys whatever the table: a proven bound for broadcasting them.
HOT_SHARE = 0.001

# Below this many rows a hot key is no load for one task.
SMALL = 1_000_000


def skew_join(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join with an aggregate that has one row per key, whatever the key's share of `rows`.

    The runtime skew rule splits a hot partition only when both sides were
    shuffled for the join itself. A side just aggregated by the key is not
    shuffled again, which turns the rule off. Written out first, the aggregate
    is a plain table: it is broadcast when small and shuffled, hence splittable,
    when not.
    """
    return rows.join(materialize(other), list(keys), how)


def sized_join(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], n_rows: int, how: str = "inner"
) -> DataFrame:
    """`skew_join` when the counted rows are enough for a hot key to matter."""
    if n_rows <= SMALL:
        return rows.join(other, list(keys), how)
    return skew_join(rows, other, keys, how)


def hot_keys(sizes: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Keys above the share, from a table of row counts per key."""
    total = sizes.agg(F.sum(size)).head()[0] or 0
    return sizes.where(F.col(size) > total * HOT_SHARE).where(F.col(size) > SMALL).select(*keys)


def split_join(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], hot: DataFrame
) -> DataFrame:
    """Inner join whose result is grouped by the same key again.

    There the runtime rule stays off, as splitting would cost the grouping
    another shuffle. Rows of hot keys stay where they are and get their few
    partners by broadcast; the rest takes the usual join. `other` and `hot` are
    written tables.
    """
    keys = list(keys)
    if hot.isEmpty():
        return rows.join(other, keys)
    hot = F.broadcast(hot)
    partners = F.broadcast(other.join(hot, keys, "left_semi"))
    here = rows.join(hot, keys, "left_semi").join(partners, keys)
    rest = rows.join(hot, keys, "left_anti").join(other, keys)
    return here.unionByName(rest)
