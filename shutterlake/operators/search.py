"""Vector lookups: top-k search, nearest clusters, gallery identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import media as M
from shutterlake.functions import vectors as V
from shutterlake.operators import kernels
from shutterlake.operators import neighbors as N
from shutterlake.operators.dedup import first_per_group
from shutterlake.operators.vectors import centroids
from shutterlake.session import BROADCAST_BYTES, materialize

GALLERY_MIN_SIMILARITY = 0.60
UNKNOWN = "unknown"
OVERFETCH = 3


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    keep: Column | None = None,
    overfetch: int | None = None,
    **route,
) -> DataFrame:
    """(query_id, id, similarity, rank) of the k best index rows per query vector.

    `index` has id, vec and the columns `keep` tests; `queries` has id and vec.
    By default `keep` is applied before ranking. With `overfetch` the reference
    order is used instead: rank `overfetch * k` rows, then test, so fewer than k
    may remain.
    """
    rows = index if keep is None or overfetch else index.where(keep)
    wanted = k * overfetch if overfetch else k
    hits = _scan_index(rows.select("id", "vec"), queries.select("id", "vec"), wanted, **route)
    if keep is not None and overfetch:
        # A scan keeps so many of every batch; only the best of all of them are tested.
        hits = first_per_group(hits, ["id"], [F.col("distance").asc(), F.col("nid").asc()], wanted)
        hits = hits.join(index.where(keep).select(F.col("id").alias("nid")), "nid", "left_semi")
    out = hits.select(
        F.col("id").alias("query_id"),
        F.col("nid").alias("id"),
        (1 - F.col("distance")).alias("similarity"),
        F.col("distance"),
    )
    return first_per_group(
        out, ["query_id"], [F.col("distance").asc(), F.col("id").asc()], k
    ).drop("distance")


def _scan_index(index: DataFrame, queries: DataFrame, k: int, **route) -> DataFrame:
    """Few queries: broadcast them and scan the big index where it lies, keeping k per batch."""
    if not N.fits_broadcast(queries, route.get("broadcast_bytes", BROADCAST_BYTES)):
        return N.knn_join(queries, index, k, **route).drop("rank")
    table = queries.toArrow()
    side = index.sparkSession.sparkContext.broadcast(
        (kernels.columns(table), kernels.matrix(table["vec"], True))
    )
    ddl = "id bigint, nid bigint, distance double"
    schema = N._arrow_schema(ddl)
    opt = {**N.DEFAULTS, "k": k}

    def scan(batches):
        cols, qm = side.value
        step = max(k, kernels.CHUNK // max(1, len(qm)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(qm) else 0, step):
                part = batch.slice(at, step)
                rm = kernels.matrix(part.column("vec"), True)
                out = kernels.nearest_k(cols, qm, kernels.columns(part), rm, opt)
                yield from kernels.to_table(out, schema).to_batches()

    return index.mapInArrow(scan, ddl)


def enrich_hits(hits: DataFrame, items: DataFrame, media: DataFrame) -> DataFrame:
    """Search hits with item and file columns; the rank column keeps their order."""
    return (
        hits.join(items.select("id", "media_id", "species", "cluster_id"), "id")
        .join(media.select("media_id", "path"), "media_id")
        .select("query_id", "rank", "id", "similarity", "species", "cluster_id", "path")
    )


def ranked(hits: DataFrame) -> DataFrame:
    """Add the rank within each query (hits are already at most k per query)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(w))


def cluster_candidates(
    faces: DataFrame,
    members: DataFrame,
    clusters: DataFrame,
    k: int = 5,
    min_size: int = 3,
    dim: int | None = None,
    **route,
) -> DataFrame:
    """Up to k nearest clusters per face with name, size, sample face and confidence."""
    cents = centroids(members, "cluster_id", "embedding", min_size=min_size)
    crows = N.vector_rows(cents, "cluster_id", "centroid", ["size"])
    if dim is not None:
        faces = faces.where(V.usable_vector(F.col("embedding"), dim))
    near = N.knn_join(N.vector_rows(faces, "id", "embedding"), crows, k, carry=["size"], **route)
    samples = (
        members.where(F.col("cluster_id").isNotNull() & F.col("thumbnail_path").isNotNull())
        .groupBy("cluster_id")
        .agg(F.min("id").alias("sample_face_id"))
    )
    names = clusters.select(F.col("id").alias("cluster_id"), "display_name")
    similarity = F.round(1 - F.col("distance"), 4)
    return (
        near.withColumnRenamed("nid", "cluster_id")
        .join(names, "cluster_id", "left")
        .join(materialize(samples), "cluster_id", "left")
        .select(
            F.col("id").alias("face_id"),
            "rank",
            "cluster_id",
            similarity.alias("similarity"),
            F.round(F.col("distance"), 4).alias("distance"),
            M.display_name(F.col("display_name"), F.col("cluster_id")).alias("person_name"),
            F.col("size").alias("face_count"),
            "sample_face_id",
            M.confidence_band(similarity).alias("confidence"),
        )
    )


def identify(
    df: DataFrame,
    gallery: DataFrame,
    min_similarity: float = GALLERY_MIN_SIMILARITY,
    key: str = "id",
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """(id, label, score): best gallery label, or `unknown` below the similarity.

    `gallery` has position, label and embedding; the earlier position wins ties.
    Rows without a usable vector score 0 against everything.
    """
    entries = N.vector_rows(gallery, "position", "embedding")
    best = N.knn_join(N.vector_rows(df, key, vector), entries, 1, **route)
    named = best.join(gallery.select(F.col("position").alias("nid"), "label"), "nid")
    score = 1 - F.col("distance")
    ok = score >= min_similarity
    return (
        df.select(F.col(key).alias("id"))
        .join(named.select("id", "label", "distance"), "id", "left")
        .select(
            "id",
            F.coalesce(F.when(ok, F.col("label")), F.lit(UNKNOWN)).alias("label"),
            score.alias("score"),
        )
    )


def label_scores(
    df: DataFrame, index: int, min_prob: float = 0.1, key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """Rows whose probability for one label reaches the minimum, best first."""
    p = F.get(F.col(vector), F.lit(index)).cast("double")
    return (
        df.select(F.col(key).alias("id"), p.alias("probability"))
        .where(F.col("probability") >= min_prob)
        .orderBy(F.desc("probability"), "id")
    )
