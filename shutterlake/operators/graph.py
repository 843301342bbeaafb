"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.skew import sized_join
from shutterlake.session import materialize, release


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("u") != F.col("v")).distinct()


def _with_minimum(edges: DataFrame, low: DataFrame, n_edges: int) -> DataFrame:
    """Join the minimum of each node to its edges."""
    return sized_join(edges, low, ["u"], n_edges)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest member id as component.

    `vertices` has id, `edges` has src and dst. Alternates the two star rounds:
    every node hooks its larger neighbours (large star), then its smaller ones
    (small star), onto the smallest id it sees. Minima are combined map-side and
    joined back by a splittable join, so a hub with a third of all edges is
    never gathered in one task. Each round is written out and the one before
    deleted. A round that changes nothing leaves stars, so the loop ends.
    """
    stars = _pairs(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")))
    stars = materialize(stars)
    n_edges = stars.count()
    if n_edges:
        while True:
            # Large star: both directions, larger neighbours move to the minimum.
            both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            up = both.where(F.col("v") > F.col("u"))
            large = _pairs(
                _with_minimum(up, low, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))
            )
            # Small star: smaller neighbours and the node itself move to the minimum.
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = _pairs(
                _with_minimum(large, low, n_edges)
                .select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v")))
            )
            new = materialize(small)
            release(stars)
            stars, n_edges = new, new.count()
            # Stable once every node points at one root and no root points on.
            ends = new.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
                new.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into"))
            )
            links = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
            if links.where((F.col("out") > 1) | (F.col("out") + F.col("into") > 1)).isEmpty():
                break
    found = stars.select(F.col("u").alias("id"), F.col("v").alias("_root"))
    return vertices.select("id").join(found, "id", "left").select(
        "id", F.coalesce("_root", "id").alias("component")
    )
