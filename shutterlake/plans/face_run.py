"""Full clustering of a face table: seed, assign noise, merge, suggest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import clustering as C
from shutterlake.operators import review as R
from shutterlake.session import materialize


class FaceRun(NamedTuple):
    faces: DataFrame
    clusters: DataFrame
    merges: DataFrame
    suggestions: DataFrame


def cluster_faces(
    faces: DataFrame,
    k: int = 50,
    seed_distance: float = 0.315,
    assign_distance: float = 0.5,
    merge_distance: float = 0.35,
    max_suggestions: int | None = None,
    band: tuple[float, float] = R.BAND,
    **route,
) -> FaceRun:
    """Run the four passes in order on (id, embedding); each pass ends in a written table.

    Faces without a usable vector are in no pass and stay noise.
    """
    base = faces.select("id", "embedding").withColumn("cluster_id", F.lit(None).cast("long"))
    seeds = C.seed_clusters(base, k, seed_distance, **route)
    seeded = materialize(base.drop("cluster_id").join(seeds, "id", "left"))
    assigned = materialize(C.assign_noise(seeded, assign_distance, **route))
    merged, mapping = C.merge_clusters(assigned, max_distance=merge_distance, **route)
    merged = materialize(merged)
    clusters = materialize(
        C.cluster_names(merged.where("cluster_id is not null").select("cluster_id").distinct())
        .withColumnRenamed("cluster_id", "id")
        .withColumn("is_hidden", F.lit(False))
    )
    new = R.new_suggestions(merged, clusters, max_suggestions, band=band, **route)
    return FaceRun(merged, clusters, mapping, new)
