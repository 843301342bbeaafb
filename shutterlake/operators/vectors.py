"""Aggregates over vector columns: centroids, cohesion, separation, views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import vectors as V
from shutterlake.operators.skew import hot_keys, split_join
from shutterlake.session import materialize

TIGHT_COHESION = 0.90


def vector_mean(v: Column) -> Column:
    """Element-wise mean as an aggregate that combines map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(v.cast("array<double>"))))


def vector_sum(v: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(v.cast("array<double>"))))


def centroids(
    df: DataFrame,
    by: str = "cluster_id",
    vector: str = "embedding",
    min_size: int = 1,
    normalize: bool = True,
    of: str = "raw",
) -> DataFrame:
    """Mean vector per cluster (`of` raw or unit vectors), with its size."""
    rows = df.where(F.col(by).isNotNull() & V.usable_vector(F.col(vector)))
    v = V.unit(F.col(vector)) if of == "unit" else F.col(vector)
    out = rows.groupBy(by).agg(vector_mean(v).alias("centroid"), F.count("*").alias("size"))
    if min_size > 1:
        out = out.where(F.col("size") >= min_size)
    if normalize:
        out = out.withColumn("centroid", V.unit(F.col("centroid")))
    return out


def cluster_statistics(
    df: DataFrame, by: str = "cluster_id", vector: str = "embedding"
) -> DataFrame:
    """Size, cohesion, variance and tightness per cluster, without pairs.

    The mean off-diagonal cosine of n vectors follows from the length of the sum
    of their unit vectors. Zero vectors count as members at cosine 0.
    """
    rows = df.where(F.col(by).isNotNull()).withColumn("_u", V.unit(F.col(vector)))
    known = F.col("_u").isNotNull()
    width = F.size(vector)
    zero = F.transform(F.sequence(F.lit(1), width), lambda i: F.lit(0.0))
    sums = rows.groupBy(by).agg(
        F.count("*").alias("size"),
        F.count_if(known).alias("_n1"),
        vector_sum(F.coalesce("_u", zero)).alias("_s"),
        V.unit(vector_mean(F.col(vector))).alias("centroid"),
    )
    n = F.col("size")
    pairs = (F.pow(V.norm(F.col("_s")), 2) - F.col("_n1")) / (n * (n - 1))
    sums = materialize(sums)
    hot = hot_keys(sums, [by], "size")
    stats = sums.withColumn("cohesion", F.when(n < 2, F.lit(1.0)).otherwise(pairs))
    # Variance of the distances: one more pass against the centroids.
    spread = (
        split_join(rows.select(by, "_u"), sums.select(by, "centroid"), [by], hot)
        .groupBy(by)
        .agg(
            F.var_pop(
                1 - F.coalesce(V.dot(F.col("_u"), F.col("centroid")), F.lit(0.0))
            ).alias("variance")
        )
    )
    return stats.join(spread, by).select(
        by,
        "size",
        "centroid",
        "cohesion",
        "variance",
        (F.col("cohesion") >= TIGHT_COHESION).alias("tight"),
    )


def separation(df: DataFrame, identity: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean cosine inside identities, mean across identities, and their difference.

    Both means come from sums of unit vectors, so no pair is formed. Extremes
    over pairs are in `neighbors.separation_extremes`.
    """
    rows = df.select(identity, V.unit(F.col(vector)).alias("_u")).where(F.col("_u").isNotNull())
    per = rows.groupBy(identity).agg(vector_sum(F.col("_u")).alias("_s"), F.count("*").alias("_n"))
    sq = F.pow(V.norm(F.col("_s")), 2)
    all_ = per.agg(
        vector_sum(F.col("_s")).alias("_t"),
        F.sum("_n").alias("_all"),
        F.sum(sq).alias("_own"),
        F.sum(sq - F.col("_n")).alias("_in"),
        F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_in_pairs"),
        F.sum(F.col("_n") * F.col("_n")).alias("_own_pairs"),
    )
    intra = F.try_divide(F.col("_in"), F.col("_in_pairs"))
    inter = F.try_divide(
        F.pow(V.norm(F.col("_t")), 2) - F.col("_own"),
        F.col("_all") * F.col("_all") - F.col("_own_pairs"),
    )
    return all_.select(
        intra.alias("intra_mean"), inter.alias("inter_mean"), (intra - inter).alias("separation")
    )


def average_views(
    df: DataFrame, weights: Mapping[str, float], key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """Weighted mean of the views of one subject, then unit length."""
    w = None
    for view, weight in weights.items():
        hit = F.col("view") == view
        w = F.when(hit, F.lit(float(weight))) if w is None else w.when(hit, F.lit(float(weight)))
    rows = df.withColumn("_w", w).where(F.col("_w").isNotNull())
    scaled = F.transform(vector, lambda x: x.cast("double") * F.col("_w"))
    sums = rows.groupBy(key).agg(vector_sum(scaled).alias("_s"), F.sum("_w").alias("_t"))
    mean = F.transform("_s", lambda x: x / F.col("_t"))
    return sums.select(key, V.unit(mean).alias("embedding"))


# View weights of the two test-time averages.
VIEWS_THREE = {"base": 2.0, "flip": 1.0, "crop": 1.0}
VIEWS_FOUR = {"base": 1.0, "face": 2.0, "crop": 1.0, "jitter": 0.5}


def vector_index(df: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, unit vector) rows, the content that searches read."""
    return df.where(V.usable_vector(F.col(vector))).select(
        key, V.unit(F.col(vector)).cast("array<float>").alias("vector")
    )
