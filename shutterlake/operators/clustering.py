"""Identity clustering on embedding tables and merging of the clusters found."""

from __future__ import annotations

import itertools

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import vectors as V
from shutterlake.operators import hierarchy as H
from shutterlake.operators import linkage as L
from shutterlake.operators import neighbors as N
from shutterlake.operators.graph import connected_components
from shutterlake.operators.ordering import number_rows
from shutterlake.operators.skew import skew_join
from shutterlake.operators.vectors import centroids, cluster_statistics
from shutterlake.session import materialize, release

NOISE = -1


def dense_labels(components: DataFrame, start: int = 0) -> DataFrame:
    """Number components by their first member: (component, cluster_id)."""
    firsts = components.select("component").distinct()
    numbered = number_rows(firsts, [], [F.col("component").asc()], "_n")
    return numbered.select("component", (F.col("_n") - 1 + start).alias("cluster_id"))


def label_components(
    components: DataFrame, min_size: int, start: int = 0, noise: int | None = None
) -> DataFrame:
    """(id, cluster_id): dense labels for components of at least min_size, else noise."""
    sizes = components.groupBy("component").agg(F.count("*").alias("_n"))
    big = dense_labels(sizes.where(F.col("_n") >= min_size), start)
    return components.join(big, "component", "left").select(
        "id", F.coalesce("cluster_id", F.lit(noise).cast("long")).alias("cluster_id")
    )


def _copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (id = first holder, size = holders) and (id, rep) of every row.

    Copies of one picture carry one vector. They are joined as a single weighted
    row, so a vector held by a third of the library costs one row, not a block.
    """
    same = rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    same = materialize(same)
    if same.where(F.col("size") > 1).isEmpty():
        return same, rows.select("id", F.col("id").alias("rep"))
    shared = same.where(F.col("size") > 1).select("vec", F.col("id").alias("rep"))
    members = rows.join(shared, "vec", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return same, members


def _spread(components: DataFrame, members: DataFrame) -> DataFrame:
    """Component of every row from the component of its representative."""
    reps = components.withColumnRenamed("id", "rep")
    return skew_join(members, reps, ["rep"]).select("id", "component")


def seed_clusters(
    df: DataFrame,
    k: int = 50,
    max_distance: float = 0.315,
    min_size: int = 2,
    key: str = "id",
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """First pass over unclustered rows: (id, cluster_id), null for noise.

    Two rows are linked when one is among the other's k nearest (itself
    included) at a cosine distance below the cut; clusters are the components.
    Only neighbours below the cut can link, so the search radius is the cut.
    """
    open_rows = df.where(F.col("cluster_id").isNull()) if "cluster_id" in df.columns else df
    rows = N.vector_rows(open_rows, key, vector)
    distinct, members = _copies(rows)
    near = N.knn_join(distinct, distinct, k, max_distance, carry=["size"], **route)
    # A row sees its own copies first; a neighbour counts while fewer than k rows precede it.
    w = W.partitionBy("id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    edges = (
        near.withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0)))
        .where((F.col("_before") < k) & (F.col("id") != F.col("nid")))
        .select(F.col("id").alias("src"), F.col("nid").alias("dst"))
    )
    found = connected_components(distinct, edges)
    return label_components(_spread(found, members), min_size)


def nearest_centroid(
    rows: DataFrame,
    cents: DataFrame,
    max_distance: float | None = None,
    metric: str = "cosine",
    **route,
) -> DataFrame:
    """(id, cluster_id, distance) of the closest centroid strictly below the cut.

    `metric` sqeuclidean is the squared L2 distance of unit vectors.
    """
    scale = 2.0 if metric == "sqeuclidean" else 1.0
    cut = None if max_distance is None else max_distance / scale
    best = N.knn_join(rows, cents, 1, cut, **route)
    return best.select(
        "id", F.col("nid").alias("cluster_id"), (F.col("distance") * scale).alias("distance")
    )


def _centroid_rows(df: DataFrame, vector: str, min_size: int, **extra) -> DataFrame:
    cents = centroids(df, "cluster_id", vector, min_size=min_size, **extra)
    return N.vector_rows(cents, "cluster_id", "centroid", ["size"])


def assign_noise(
    df: DataFrame,
    max_distance: float = 0.5,
    metric: str = "sqeuclidean",
    min_size: int = 3,
    key: str = "id",
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """Second pass: df with noise rows given to the nearest centroid below the cut."""
    cents = materialize(_centroid_rows(df, vector, min_size))
    noise = N.vector_rows(df.where(F.col("cluster_id").isNull()), key, vector)
    found = nearest_centroid(noise, cents, max_distance, metric, **route).select(
        F.col("id").alias(key), F.col("cluster_id").alias("_found")
    )
    return df.join(found, key, "left").select(
        *[
            F.coalesce("cluster_id", "_found").alias("cluster_id") if c == "cluster_id" else c
            for c in df.columns
        ]
    )


def merge_map(
    sizes: DataFrame, edges: DataFrame, survivor: str = "largest"
) -> DataFrame:
    """(source, target) for every cluster that a merge removes.

    `sizes` has id and size. The survivor is the largest cluster of a component
    (smallest id on ties), or simply the smallest id.
    """
    comp = connected_components(sizes, edges).join(sizes.select("id", "size"), "id")
    if survivor == "largest":
        keep = comp.groupBy("component").agg(
            F.max_by("id", F.struct("size", -F.col("id"))).alias("target")
        )
    else:
        keep = comp.groupBy("component").agg(F.min("id").alias("target"))
    return (
        skew_join(comp, keep, ["component"])
        .where(F.col("id") != F.col("target"))
        .select(F.col("id").alias("source"), "target")
    )


def relabel(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move members of merged clusters to their survivor."""
    to = mapping.select(F.col("source").alias("cluster_id"), F.col("target").alias("_to"))
    return df.join(to, "cluster_id", "left").select(
        *[
            F.coalesce("_to", "cluster_id").alias("cluster_id") if c == "cluster_id" else c
            for c in df.columns
        ]
    )


def person_merge_map(
    df: DataFrame,
    k: int = 10,
    max_distance: float = 0.35,
    min_size: int = 3,
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """Third pass: clusters whose centroids are mutual or one-way near neighbours."""
    cents = materialize(_centroid_rows(df, vector, min_size))
    near = N.knn_join(cents, cents, k, max_distance, **route)
    edges = near.where(F.col("id") != F.col("nid")).select(
        F.col("id").alias("src"), F.col("nid").alias("dst")
    )
    return merge_map(cents, edges)


def merge_clusters(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Relabelled rows and the (source, target) merges behind them."""
    mapping = materialize(person_merge_map(df, **options))
    return relabel(df, mapping), mapping


def merge_capped(
    df: DataFrame,
    min_similarity: float = 0.85,
    cap: int = 50,
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """(source, target): centroid pairs at the similarity whose sizes sum to the cap at most.

    Sizes are those before the merge, and pairs chain, so a merged group may
    still exceed the cap.
    """
    cents = materialize(_centroid_rows(df, vector, 1))
    edges = N.component_edges(cents, 1 - min_similarity, closed=True, cap=cap, **route)
    return merge_map(cents, edges, survivor="smallest")


def merge_multipass(
    df: DataFrame,
    min_similarity: float = 0.80,
    tight: float = 0.90,
    tight_slack: float = 0.05,
    cap: int = 100,
    passes: int | None = None,
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """Repeat the capped merge with fresh statistics; tight clusters get some slack.

    Ends when a pass finds no pair, or after `passes` if that is given; each pass
    removes a cluster, so it does end. Returns the rows with their final cluster.
    """
    rows = materialize(df)
    for _ in itertools.count() if passes is None else range(passes):
        stats = cluster_statistics(rows, "cluster_id", vector).withColumn(
            "firm", (F.col("cohesion") >= tight) & (F.col("size") >= 2)
        )
        cents = materialize(N.vector_rows(stats, "cluster_id", "centroid", ["size", "firm"]))
        loose = N.component_edges(cents, 1 - min_similarity, closed=True, cap=cap, **route)
        firm = N.component_edges(
            cents, 1 - (min_similarity - tight_slack), closed=True, cap=cap, both="firm", **route
        )
        mapping = materialize(merge_map(cents, loose.unionByName(firm), survivor="smallest"))
        if mapping.isEmpty():
            break
        rows = materialize(relabel(rows, mapping))
    return rows


def dbscan(
    df: DataFrame,
    eps: float,
    min_samples: int = 2,
    metric: str = "cosine",
    key: str = "id",
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """(id, cluster_id): density clusters, -1 for noise.

    A row is core when at least min_samples rows (itself included) lie within
    eps. Border rows join the lowest-numbered adjacent cluster. With two samples
    every linked row is core, so components alone decide.
    """
    rows = materialize(N.vector_rows(df, key, vector))
    if min_samples <= 2:
        edges = N.component_edges(rows, eps, closed=True, metric=metric, **route)
        return label_components(
            connected_components(rows, edges), max(1, min_samples), noise=NOISE
        )
    counts = N.neighbour_counts(rows, eps, True, metric, **route)
    core = materialize(
        rows.join(counts, "id").where(F.col("n") >= min_samples).select("id", "vec")
    )
    edges = N.component_edges(core, eps, closed=True, metric=metric, **route)
    labels = materialize(label_components(connected_components(core, edges), 1))
    border = rows.join(core.select("id"), "id", "left_anti")
    labelled = core.join(labels, "id").select("id", "vec", F.col("cluster_id").alias("label"))
    near = N.lowest_labels(border, labelled, eps, True, metric, **route)
    known = labels.unionByName(near.select("id", F.col("label").alias("cluster_id")))
    return rows.select("id").join(known, "id", "left").select(
        "id", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id")
    )


def density_cluster(
    df: DataFrame,
    eps: float = 0.15,
    soft: float = 0.15,
    min_size: int = 2,
    key: str = "id",
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """Flat density cut at eps, then noise within `soft` of a raw-mean centroid joins it.

    This is the cut of the density hierarchy at one level; `density_hierarchy`
    also finds the clusters that are born above it.
    """
    rows = materialize(N.vector_rows(df, key, vector))
    edges = N.component_edges(rows, eps, closed=True, **route)
    labels = label_components(connected_components(rows, edges), min_size)
    return _near_noise_joins(materialize(rows.join(labels, "id")), soft, **route)


def _near_noise_joins(placed: DataFrame, soft: float, **route) -> DataFrame:
    """(id, cluster_id): noise within `soft` of a raw-mean centroid joins it, other noise is -1."""
    cents = materialize(
        N.vector_rows(
            centroids(placed, "cluster_id", "vec", normalize=False), "cluster_id", "centroid"
        )
    )
    noise = placed.where(F.col("cluster_id").isNull()).select("id", "vec")
    found = nearest_centroid(noise, cents, soft, **route).select(
        "id", F.col("cluster_id").alias("_found")
    )
    return (
        placed.select("id", "cluster_id")
        .join(found, "id", "left")
        .select("id", F.coalesce("cluster_id", "_found", F.lit(NOISE)).alias("cluster_id"))
    )


def density_hierarchy(
    df: DataFrame,
    epsilon: float = 0.15,
    soft: float = 0.15,
    min_size: int = 2,
    min_samples: int = 1,
    max_distance: float | None = None,
    key: str = "id",
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """(id, cluster_id): clusters of greatest stability, then noise within `soft` of a centroid joins it.

    Chosen clusters born below epsilon give way to the one around them that is
    born above. Copies of a vector are one weighted row. With a maximum distance
    the hierarchy ends there, and what is then a root is never chosen.
    """
    rows = materialize(N.vector_rows(df, key, vector))
    distinct, members = _copies(rows)
    with_core, lists = H.reachable(distinct, min_samples, **route)
    edges, _ = H.spanning_forest(with_core, lists, max_distance, **route)
    tree, points = H.condensed_tree(with_core, edges, min_size)
    chosen = H.select_clusters(tree, epsilon).where("chosen IS NOT NULL")
    known = points.join(materialize(chosen), "cluster").select("id", F.col("chosen").alias("component"))
    labelled = materialize(skew_join(members, known.withColumnRenamed("id", "rep"), ["rep"]))
    firsts = labelled.groupBy("component").agg(F.min("id").alias("first"))
    numbers = dense_labels(firsts.select(F.col("first").alias("component"))).withColumnRenamed("component", "first")
    named = materialize(firsts.join(numbers, "first").select("component", "cluster_id"))
    labels = skew_join(labelled, named, ["component"]).select("id", "cluster_id")
    return _near_noise_joins(materialize(rows.join(labels, "id", "left")), soft, **route)


def average_linkage(
    df: DataFrame,
    max_distance: float = 0.20,
    key: str = "id",
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """(id, cluster_id) of average-linkage clustering on cosine distance, cut at a height."""
    rows = N.vector_rows(df, key, vector).select("id", V.unit(F.col("vec")).alias("vec"))
    distinct, members = _copies(rows)
    merges, _ = L.agglomerate(_totals(distinct), "average", max_distance, **route)
    edges = merges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return label_components(_spread(connected_components(distinct, edges), members), 1)


def _totals(distinct: DataFrame) -> DataFrame:
    return distinct.select("id", F.transform("vec", lambda x: x * F.col("size")).alias("total"), "size")


def ward_merges(df: DataFrame, key: str = "id", vector: str = "embedding", **route) -> DataFrame:
    """(source, target, height): the whole merge table under Ward's cost, one merge less than vectors."""
    distinct, _ = _copies(materialize(N.vector_rows(df, key, vector)))
    return L.agglomerate(_totals(distinct), "ward", **route)[0]


def ward(df: DataFrame, k: int, key: str = "id", vector: str = "embedding", **route) -> DataFrame:
    """(id, cluster_id): k clusters by Ward's method, or one per distinct vector if there are fewer.

    The cheapest merges are those that lead to k clusters, as no merge costs less
    than one inside it.
    """
    rows = materialize(N.vector_rows(df, key, vector))
    distinct, members = _copies(rows)
    merges, _ = L.agglomerate(_totals(distinct), "ward", **route)
    ranked = number_rows(merges, [], [F.col("height").asc(), F.col("source").asc()], "_n")
    edges = ranked.where(F.col("_n") <= distinct.count() - max(1, k))
    edges = materialize(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return label_components(_spread(connected_components(distinct, edges), members), 1)


def bisecting(
    df: DataFrame, k: int, seed: int = 42, key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """(id, cluster_id): fixed number of clusters of low variance.

    Same objective as `ward` (variance inside clusters) reached from the other
    side, by splitting instead of merging, so single labels can differ.
    """
    rows = df.where(V.usable_vector(F.col(vector))).select(
        F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")
    )
    rows = materialize(rows.orderBy("id"))
    model = BisectingKMeans(k=max(2, min(k, rows.count())), seed=seed).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").cast("long").alias("cluster_id"))


def project_2d(df: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, x, y): first two principal components, signs arbitrary."""
    rows = df.where(V.usable_vector(F.col(vector))).select(
        F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")
    )
    model = PCA(k=2, inputCol="features", outputCol="_p").fit(rows)
    xy = vector_to_array("_p")
    return model.transform(rows).select("id", F.get(xy, 0).alias("x"), F.get(xy, 1).alias("y"))


def offset_ids(labels: DataFrame, offset: int = 10000) -> DataFrame:
    """Shift cluster ids of the second species; noise stays noise."""
    return labels.withColumn(
        "cluster_id",
        F.when(F.col("cluster_id") == NOISE, NOISE).otherwise(F.col("cluster_id") + offset),
    )


def cluster_names(clusters: DataFrame, prefix: str = "Person ", first: int = 0) -> DataFrame:
    return clusters.withColumn(
        "display_name", F.concat(F.lit(prefix), (F.col("cluster_id") + first).cast("string"))
    )
