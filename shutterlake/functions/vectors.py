"""Vector expressions over array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(v: Column) -> Column:
    """Vector of length one; a zero vector becomes null."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def cosine_to_distance(similarity: Column) -> Column:
    return 1 - similarity


def distance_to_sqeuclidean(cosine_distance: Column) -> Column:
    """Squared L2 distance of two unit vectors."""
    return 2 * cosine_distance


def sqeuclidean_to_similarity(squared: Column) -> Column:
    return 1 - squared / 2


def usable_vector(v: Column, dim: int | None = None) -> Column:
    """Not null, not all zero and, when asked, of the declared width."""
    ok = v.isNotNull() & F.exists(v, lambda x: x != 0)
    return ok & (F.size(v) == dim) if dim else ok


def trim_vector(v: Column, dim: Column) -> Column:
    return F.slice(v, F.lit(1), dim)
