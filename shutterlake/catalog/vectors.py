"""Queries over embedding tables: centroids, joins, clustering, merging.

The given vectors are nearly random (no two reach a cosine of 0.7), so these
queries pass their own distance limits; the operators keep the usual defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.catalog.core import clusters, faces, query, table
from shutterlake.functions import vectors as V
from shutterlake.operators import clustering as C
from shutterlake.operators import lsh as LSH
from shutterlake.operators import neighbors as N
from shutterlake.operators import search as Q
from shutterlake.operators import vector_index as VI
from shutterlake.operators import vectors as X
from shutterlake.operators.skew import skew_join
from shutterlake.plans.face_run import cluster_faces
from shutterlake.session import materialize, scratch_path

LINK = 0.60  # cosine distance that links a few percent of the rows

PAIR = "1 - list_inner_product(a.u, b.u)"
LINKS = f"SELECT a.id AS src, b.id AS dst FROM {{unit}} a, {{unit}} b WHERE a.id <> b.id AND {PAIR} <= {LINK}"


def components_sql(links: str, nodes: str) -> str:
    """Recursive closure; the component is the smallest reachable id."""
    return f"""
      WITH RECURSIVE links AS MATERIALIZED ({links}),
        nodes AS (SELECT id FROM {nodes}),
        reach AS (SELECT id, id AS other FROM nodes
          UNION SELECT r.id, l.dst FROM reach r JOIN links l ON l.src = r.other),
        comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
        sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY component),
        dense AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster_id FROM sizes WHERE n >= 2)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    return N.vector_rows(faces(spark, d), "id", "embedding")


# ---- vector functions ---------------------------------------------------------------


@query(
    "h5_h6_h7_vector_functions",
    """SELECT a.id, round(sqrt(list_inner_product(a.embedding, a.embedding)), 6) AS norm, round(s, 6) AS cosine,
         round(1 - s, 6) AS distance, round(2 * (1 - s), 6) AS squared, round(1 - (2 * (1 - s)) / 2, 6) AS back
       FROM (SELECT f.id, f.embedding, list_cosine_similarity(f.embedding, c.c) AS s
             FROM {faces} f JOIN {label_centroid} c ON c.label = f.label) a""",
)
def h5(spark, d):
    cents = X.centroids(faces(spark, d), "label").select("label", "centroid")
    s = V.cosine(F.col("embedding"), F.col("centroid"))
    dist = V.cosine_to_distance(s)
    squared = V.distance_to_sqeuclidean(dist)
    return skew_join(faces(spark, d), cents, ["label"]).select(
        "id",
        F.round(V.norm(F.col("embedding")), 6).alias("norm"),
        F.round(s, 6).alias("cosine"),
        F.round(dist, 6).alias("distance"),
        F.round(squared, 6).alias("squared"),
        F.round(V.sqeuclidean_to_similarity(squared), 6).alias("back"),
    )


@query(
    "i19_vector_index",
    "SELECT id, round(list_sum(u), 3) AS total, len(u)::INT AS dim FROM {unit}",
)
def i19(spark, d):
    index = X.vector_index(faces(spark, d))
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return index.select("id", F.round(total, 3).alias("total"), F.size("vector").alias("dim"))


# ---- aggregates --------------------------------------------------------------------


@query(
    "d14_centroids",
    """SELECT cluster_id, size, i, round(x, 6) AS x FROM (
         SELECT cluster_id, size, unnest(c) AS x, unnest(range(0, len(c))) AS i FROM {centroid}) WHERE size >= 3""",
)
def d14(spark, d):
    cents = X.centroids(faces(spark, d), min_size=3)
    return cents.select("cluster_id", "size", F.posexplode("centroid").alias("i", "x")).withColumns(
        {"x": F.round("x", 6), "i": F.col("i").cast("long")}
    )


@query(
    "d15_cluster_statistics",
    """WITH p AS (SELECT a.cluster_id, avg(list_inner_product(a.u, b.u)) AS cohesion
         FROM {unit} a JOIN {unit} b ON a.cluster_id = b.cluster_id AND a.id <> b.id GROUP BY 1)
       SELECT c.cluster_id, c.size, round(coalesce(p.cohesion, 1.0), 6) AS cohesion, round(v.variance, 6) AS variance,
         coalesce(p.cohesion, 1.0) >= 0.9 AS tight
       FROM {centroid} c LEFT JOIN p ON p.cluster_id = c.cluster_id
       JOIN (SELECT u.cluster_id, var_pop(1 - list_inner_product(u.u, c.c)) AS variance
             FROM {unit} u JOIN {centroid} c ON c.cluster_id = u.cluster_id GROUP BY 1) v ON v.cluster_id = c.cluster_id""",
)
def d15(spark, d):
    s = X.cluster_statistics(faces(spark, d))
    return s.select(
        "cluster_id", "size", F.round("cohesion", 6).alias("cohesion"),
        F.round("variance", 6).alias("variance"), "tight",
    )


@query(
    "d25_separation",
    """WITH p AS (SELECT a.label = b.label AS same, list_inner_product(a.u, b.u) AS s FROM {unit} a, {unit} b WHERE a.id <> b.id)
       SELECT round(avg(s) FILTER (same), 6) AS intra_mean, round(avg(s) FILTER (NOT same), 6) AS inter_mean,
         round(avg(s) FILTER (same) - avg(s) FILTER (NOT same), 6) AS separation FROM p""",
)
def d25(spark, d):
    s = X.separation(faces(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(
    "d25_separation_extremes",
    """SELECT a.label, round(min(list_inner_product(a.u, b.u)) FILTER (a.label = b.label), 6) AS intra_min,
         round(max(list_inner_product(a.u, b.u)) FILTER (a.label <> b.label), 6) AS inter_max
       FROM {unit} a, {unit} b WHERE a.id <> b.id GROUP BY a.label""",
)
def d25_extremes(spark, d):
    r = N.vector_rows(faces(spark, d), "id", "embedding", ["label"])
    s = N.separation_extremes(r)
    return s.select(
        "label", F.round("intra_min", 6).alias("intra_min"), F.round("inter_max", 6).alias("inter_max")
    )


VIEW = "CASE vec_id % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'face' WHEN 2 THEN 'crop' ELSE 'jitter' END"


@query(
    "d34_average_views",
    """WITH v AS (SELECT id // 4 AS subject, i, sum(x * w) / sum(w) AS x FROM (
           SELECT *, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.5 END AS w FROM {dims}) GROUP BY 1, 2),
         n AS (SELECT subject, sqrt(sum(x * x)) AS n FROM v GROUP BY 1)
       SELECT v.subject, i - 1 AS i, round(x / n, 6) AS x FROM v JOIN n ON n.subject = v.subject""",
)
def d34(spark, d):
    n = F.col("id") % 4
    view = F.when(n == 0, "base").when(n == 1, "face").when(n == 2, "crop").otherwise("jitter")
    views = faces(spark, d).select(
        F.floor(F.col("id") / 4).alias("subject"), view.alias("view"), "embedding"
    )
    mean = X.average_views(views, X.VIEWS_FOUR, key="subject")
    return mean.select("subject", F.posexplode("embedding").alias("i", "x")).select(
        "subject", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")
    )


# ---- joins ---------------------------------------------------------------------------


@query(
    "c12_knn_join",
    f"""SELECT id, nid, rank::INT AS rank, round(distance, 6) AS distance FROM (
          SELECT a.id, b.id AS nid, {PAIR} AS distance,
            row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN a.id = b.id THEN 0 ELSE {PAIR} END, b.id) AS rank
          FROM {{unit}} a, {{unit}} b) WHERE rank <= 50""",
)
def c12(spark, d):
    r = rows(spark, d)
    return N.knn_join(r, r, 50).select("id", "nid", "rank", F.round(F.abs("distance"), 6).alias("distance"))


@query(
    "i1_similarity_join",
    f"""SELECT a.id AS src, b.id AS dst, round({PAIR}, 6) AS distance
        FROM {{unit}} a, {{unit}} b WHERE a.id < b.id AND {PAIR} <= {LINK}""",
)
def i1(spark, d):
    p = N.similar_pairs(rows(spark, d), LINK)
    return p.select("src", "dst", F.round("distance", 6).alias("distance"))


@query(
    "i1_similarity_join_cells",
    f"""SELECT a.id AS src, b.id AS dst, round({PAIR}, 6) AS distance
        FROM {{unit}} a, {{unit}} b WHERE a.id < b.id AND {PAIR} <= {LINK}""",
)
def i1_cells(spark, d):
    """The same join by the route for tables too large to broadcast."""
    p = N.similar_pairs(rows(spark, d), LINK, broadcast_bytes=0, block_rows=128)
    return p.select("src", "dst", F.round("distance", 6).alias("distance"))


@query(
    "i2_approximate_join",
    f"""SELECT count(*) AS exact, 0::BIGINT AS wrong, true AS reached
        FROM {{unit}} a, {{unit}} b WHERE a.id < b.id AND {PAIR} <= {LINK}""",
)
def i2(spark, d):
    """The approximate join against the exact one: nothing wrong, and at least nine in ten found."""
    all_rows = rows(spark, d)
    found = LSH.approximate_pairs(all_rows, LINK, bits=6, block_rows=256)
    recall = LSH.measured_recall(N.similar_pairs(all_rows, LINK), found)
    return recall.select("exact", "wrong", (F.col("recall") >= 0.9).alias("reached"))


@query("i2_approximate_pairs")
def i2_pairs(spark, d):
    return LSH.approximate_pairs(rows(spark, d), LINK)


@query(
    "c11_nearest_centroid",
    """SELECT id, cluster_id, round(distance, 6) AS distance FROM (
         SELECT u.id, c.cluster_id, 2 * (1 - list_inner_product(u.u, c.c)) AS distance,
           row_number() OVER (PARTITION BY u.id ORDER BY list_inner_product(u.u, c.c) DESC, c.cluster_id) AS rn
         FROM {unit} u, {centroid} c WHERE u.cluster_id IS NULL AND c.size >= 3) WHERE rn = 1 AND distance < 1.6""",
)
def c11(spark, d):
    f = faces(spark, d)
    cents = N.vector_rows(X.centroids(f, min_size=3), "cluster_id", "centroid")
    noise = N.vector_rows(f.where("cluster_id is null"), "id", "embedding")
    out = C.nearest_centroid(noise, cents, 1.6, "sqeuclidean")
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "i5_assign_noise",
    """SELECT f.id, coalesce(f.cluster_id, n.cluster_id, -1) AS cluster_id FROM {faces} f LEFT JOIN (
         SELECT u.id, c.cluster_id, row_number() OVER (PARTITION BY u.id ORDER BY list_inner_product(u.u, c.c) DESC, c.cluster_id) AS rn,
           2 * (1 - list_inner_product(u.u, c.c)) AS distance
         FROM {unit} u, {centroid} c WHERE u.cluster_id IS NULL AND c.size >= 3) n ON n.id = f.id AND n.rn = 1 AND n.distance < 1.5""",
)
def i5(spark, d):
    out = C.assign_noise(faces(spark, d).select("id", "embedding", "cluster_id"), 1.5)
    return out.select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query(
    "c10_nearest_clustered_face",
    f"""SELECT id, nid, cluster_id, round(distance, 6) AS distance FROM (
          SELECT a.id, b.id AS nid, b.cluster_id, {PAIR} AS distance, row_number() OVER (PARTITION BY a.id ORDER BY {PAIR}, b.id) AS rn
          FROM {{unit}} a, {{unit}} b WHERE a.cluster_id IS NULL AND b.cluster_id IS NOT NULL) WHERE rn = 1""",
)
def c10(spark, d):
    f = faces(spark, d)
    noise = N.vector_rows(f.where("cluster_id is null"), "id", "embedding")
    known = N.vector_rows(f.where("cluster_id is not null"), "id", "embedding", ["cluster_id"])
    out = N.knn_join(noise, known, 1, carry=["cluster_id"])
    return out.select("id", "nid", "cluster_id", F.round("distance", 6).alias("distance"))


@query(
    "c13_centroid_knn",
    """SELECT id, nid, round(abs(distance), 6) AS distance FROM (
         SELECT a.cluster_id AS id, b.cluster_id AS nid, 1 - list_inner_product(a.c, b.c) AS distance,
           row_number() OVER (PARTITION BY a.cluster_id ORDER BY CASE WHEN a.cluster_id = b.cluster_id THEN 0 ELSE 1 - list_inner_product(a.c, b.c) END, b.cluster_id) AS rn
         FROM {centroid} a, {centroid} b) WHERE rn <= 5""",
)
def c13(spark, d):
    cents = N.vector_rows(X.centroids(faces(spark, d)), "cluster_id", "centroid")
    out = N.knn_join(cents, cents, 5)
    return out.select("id", "nid", F.round(F.abs("distance"), 6).alias("distance"))


@query(
    "c14_cluster_candidates",
    """SELECT face_id, rank::INT AS rank, k.cluster_id, round(s, 4) AS similarity, round(1 - s, 4) AS distance,
         coalesce(n.display_name, 'Person ' || k.cluster_id) AS person_name, k.size AS face_count, m.sample_face_id,
         CASE WHEN round(s, 4) > 0.85 THEN 'high_confidence' WHEN round(s, 4) >= 0.75 THEN 'moderate'
           WHEN round(s, 4) >= 0.65 THEN 'low' ELSE 'none' END AS confidence
       FROM (SELECT u.id AS face_id, c.cluster_id, c.size, list_inner_product(u.u, c.c) AS s,
               row_number() OVER (PARTITION BY u.id ORDER BY list_inner_product(u.u, c.c) DESC, c.cluster_id) AS rank
             FROM {unit} u, {centroid} c WHERE u.cluster_id IS NULL AND c.size >= 3) k
       LEFT JOIN {clusters} n ON n.id = k.cluster_id
       LEFT JOIN (SELECT cluster_id, min(id) AS sample_face_id FROM {faces} WHERE cluster_id IS NOT NULL AND thumbnail_path IS NOT NULL GROUP BY 1) m
         ON m.cluster_id = k.cluster_id WHERE rank <= 5""",
)
def c14(spark, d):
    f = faces(spark, d)
    return Q.cluster_candidates(f.where("cluster_id is null"), f, clusters(spark, d), dim=64)


def label_queries(spark: SparkSession, d: str) -> DataFrame:
    cents = X.centroids(faces(spark, d), "label")
    return N.vector_rows(cents, "label", "centroid")


SEARCH = """SELECT query_id, id, round(s, 6) AS similarity FROM (
  SELECT c.label AS query_id, u.id, list_inner_product(u.u, c.c) AS s, u.species,
    row_number() OVER (PARTITION BY c.label ORDER BY list_inner_product(u.u, c.c) DESC, u.id) AS rn
  FROM {unit} u, {label_centroid} c %s) WHERE rn <= %d AND species = 'dog' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rn) <= 10"""


@query("c15_search_prefiltered", SEARCH % ("WHERE u.species = 'dog'", 10))
def c15(spark, d):
    index = N.vector_rows(faces(spark, d), "id", "embedding", ["species"])
    hits = Q.search(index, label_queries(spark, d), 10, keep=F.col("species") == "dog")
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("c15_i19_stored_index", SEARCH % ("WHERE u.species = 'dog'", 10))
def c15_stored(spark, d):
    """The same search over an index that was stored in two batches."""
    f = faces(spark, d)
    path = scratch_path(spark, "index")
    VI.write_index(f.where("id % 3 <> 0"), path, carry=["species"], cell_rows=64)
    VI.add_rows(f.where("id % 3 = 0"), path, carry=["species"])
    hits = VI.search_index(spark, path, label_queries(spark, d), 10, keep=F.col("species") == "dog")
    return hits.select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("c15_search_overfetch", SEARCH % ("", 30))
def c15_over(spark, d):
    index = N.vector_rows(faces(spark, d), "id", "embedding", ["species"])
    hits = Q.search(index, label_queries(spark, d), 10, keep=F.col("species") == "dog", overfetch=3)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query(
    "c9_search_enriched",
    """WITH h AS (SELECT c.label AS query_id, u.id, list_inner_product(u.u, c.c) AS s,
           row_number() OVER (PARTITION BY c.label ORDER BY list_inner_product(u.u, c.c) DESC, u.id) AS rn
         FROM {unit} u, {label_centroid} c)
       SELECT query_id, rn::INT AS rank, h.id, round(s, 6) AS similarity, f.species, coalesce(f.cluster_id, -1) AS cluster_id, m.path
       FROM h JOIN {faces} f ON f.id = h.id JOIN {media} m ON m.media_id = f.media_id WHERE rn <= 10""",
)
def c9(spark, d):
    from shutterlake.catalog.core import media

    f = faces(spark, d)
    index = N.vector_rows(f, "id", "embedding")
    hits = Q.ranked(Q.search(index, label_queries(spark, d), 10))
    out = Q.enrich_hits(hits, f, media(spark, d))
    return out.select(
        "query_id", "rank", "id", F.round("similarity", 6).alias("similarity"), "species",
        F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "path",
    )


@query(
    "c16_identify",
    """SELECT id, CASE WHEN s >= 0.25 THEN 'name' || label ELSE 'unknown' END AS label, round(s, 6) AS score FROM (
         SELECT u.id, c.label, list_inner_product(u.u, c.c) AS s,
           row_number() OVER (PARTITION BY u.id ORDER BY list_inner_product(u.u, c.c) DESC, c.label) AS rn
         FROM {unit} u, {label_centroid} c) WHERE rn = 1""",
)
def c16(spark, d):
    cents = X.centroids(faces(spark, d), "label")
    gallery = cents.select(
        F.col("label").alias("position"),
        F.concat(F.lit("name"), "label").alias("label"),
        F.col("centroid").alias("embedding"),
    )
    return Q.identify(faces(spark, d), gallery, 0.25).withColumn("score", F.round("score", 6))


@query(
    "b9_label_scores",
    "SELECT id, embedding[4] AS probability FROM {faces} WHERE embedding[4] >= 0.1",
)
def b9(spark, d):
    return Q.label_scores(faces(spark, d), 3, 0.1)


@query(
    "c19_mergeable_pairs",
    """SELECT a.cluster_id AS src, b.cluster_id AS dst, round(1 - list_inner_product(a.c, b.c), 6) AS distance
       FROM {centroid} a, {centroid} b WHERE a.cluster_id < b.cluster_id
         AND list_inner_product(a.c, b.c) >= 0.1 AND a.size + b.size <= 100000""",
)
def c19(spark, d):
    cents = N.vector_rows(X.centroids(faces(spark, d)), "cluster_id", "centroid", ["size"])
    p = N.similar_pairs(cents, 0.9, cap=100000)
    return p.withColumn("distance", F.round("distance", 6))


# ---- clustering ------------------------------------------------------------------------


@query(
    "i3_connected_components",
    components_sql(LINKS, "{unit}") + " SELECT id, component FROM comp",
)
def i3(spark, d):
    from shutterlake.operators.graph import connected_components

    r = rows(spark, d)
    return connected_components(r, N.similar_pairs(r, LINK).select("src", "dst"))


KNN_LINKS = f"""
  SELECT a AS src, b AS dst FROM (SELECT unnest([[x, y], [y, x]]) AS p, p[1] AS a, p[2] AS b FROM (
    SELECT a.id AS x, b.id AS y, {PAIR} AS dist,
      row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN a.id = b.id THEN 0 ELSE {PAIR} END, b.id) AS rn
    FROM {{unit}} a, {{unit}} b) WHERE rn <= 50 AND dist < {LINK} AND x <> y)"""


@query(
    "i4_seed_clusters",
    components_sql(KNN_LINKS, "{unit}")
    + " SELECT id, coalesce(cluster_id, -1) AS cluster_id FROM comp LEFT JOIN dense USING (component)",
)
def i4(spark, d):
    found = C.seed_clusters(faces(spark, d).drop("cluster_id"), 50, LINK)
    return found.select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query(
    "i10_dbscan",
    components_sql(LINKS, "{unit}")
    + " SELECT id, coalesce(cluster_id, -1) AS cluster_id FROM comp LEFT JOIN dense USING (component)",
)
def i10(spark, d):
    return C.dbscan(faces(spark, d), LINK)


CORE_LINKS = LINKS.replace(str(LINK), "0.66")


@query(
    "i10_dbscan_border",
    f"""WITH RECURSIVE near AS MATERIALIZED ({CORE_LINKS}),
         core AS (SELECT src AS id FROM near GROUP BY src HAVING count(*) + 1 >= 4),
         links AS MATERIALIZED (SELECT src, dst FROM near WHERE src IN (FROM core) AND dst IN (FROM core)),
         reach AS (SELECT id, id AS other FROM core
           UNION SELECT r.id, l.dst FROM reach r JOIN links l ON l.src = r.other),
         comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
         dense AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS label FROM (SELECT DISTINCT component FROM comp)),
         lab AS (SELECT id, label FROM comp JOIN dense USING (component)),
         border AS (SELECT src AS id, min(label) AS label FROM near JOIN lab ON lab.id = near.dst WHERE src NOT IN (FROM core) GROUP BY src)
       SELECT f.id, coalesce(lab.label, border.label, -1) AS cluster_id
       FROM {{faces}} f LEFT JOIN lab ON lab.id = f.id LEFT JOIN border ON border.id = f.id""",
)
def i10_border(spark, d):
    return C.dbscan(faces(spark, d), 0.66, min_samples=4)


@query(
    "i10_dbscan_euclidean",
    components_sql(
        "SELECT a.id AS src, b.id AS dst FROM {faces} a, {faces} b WHERE a.id <> b.id AND list_distance(a.embedding, b.embedding) <= 1.1",
        "{faces}",
    )
    + " SELECT id, coalesce(cluster_id, -1) AS cluster_id FROM comp LEFT JOIN dense USING (component)",
)
def i10_euclidean(spark, d):
    return C.dbscan(faces(spark, d), 1.1, metric="euclidean")


def mean_sql(labels: str, least: int = 1) -> str:
    """Mean vector and size of each cluster of a table of (id, cluster_id)."""
    return f"""(SELECT cluster_id, max(n) AS size, list(x ORDER BY i) AS c FROM (
        SELECT l.cluster_id, d.i, avg(d.x) AS x, count(*) AS n FROM {labels} l JOIN {{dims}} d ON d.id = l.id
        WHERE l.cluster_id IS NOT NULL GROUP BY l.cluster_id, d.i) GROUP BY cluster_id HAVING max(n) >= {least})"""


def nearest_sql(labels: str, means: str, cut: str) -> str:
    """Rows without a cluster go to the nearest mean under the cut on s, the cosine."""
    return f"""(SELECT l.id, coalesce(l.cluster_id, n.cluster_id) AS cluster_id FROM {labels} l LEFT JOIN (
        SELECT f.id, m.cluster_id, list_cosine_similarity(f.embedding, m.c) AS s,
          row_number() OVER (PARTITION BY f.id ORDER BY list_cosine_similarity(f.embedding, m.c) DESC, m.cluster_id) AS rn
        FROM {{faces}} f JOIN {labels} o ON o.id = f.id AND o.cluster_id IS NULL, {means} m) n ON n.id = l.id AND n.rn = 1 AND {cut})"""


@query(
    "i11_density_cluster",
    components_sql(LINKS, "{unit}")
    + ", lab AS (SELECT id, cluster_id FROM comp LEFT JOIN dense USING (component)), means AS MATERIALIZED "
    + mean_sql("lab")
    + " SELECT id, coalesce(cluster_id, -1) AS cluster_id FROM "
    + nearest_sql("lab", "means", "1 - n.s < 0.5"),
)
def i11(spark, d):
    return C.density_cluster(faces(spark, d), LINK, 0.5)


@query("i11_density_hierarchy")
def i11_hierarchy(spark, d):
    return C.density_hierarchy(faces(spark, d), 0.15, 0.5, 3)


@query("i12_average_linkage")
def i12(spark, d):
    return C.average_linkage(faces(spark, d), 0.65)


@query("i13_ward")
def i13_ward(spark, d):
    return C.ward(faces(spark, d), 80)


@query("i13_bisecting")
def i13(spark, d):
    return C.bisecting(faces(spark, d), 80)


@query("i18_projection")
def i18(spark, d):
    return C.project_2d(faces(spark, d))


MERGE_LINKS = """
  SELECT a.cluster_id AS src, b.cluster_id AS dst FROM {centroid} a, {centroid} b
  WHERE a.cluster_id <> b.cluster_id AND a.size >= 3 AND b.size >= 3 AND 1 - list_inner_product(a.c, b.c) < 0.85"""


def merge_sql(links: str, best: str) -> str:
    return (
        components_sql(links, "(SELECT cluster_id AS id FROM {centroid})")
        + f""", keep AS (SELECT component, {best} AS target
             FROM comp JOIN {{centroid}} c ON c.cluster_id = comp.id GROUP BY component)
           SELECT id AS source, target FROM comp JOIN keep USING (component) WHERE id <> target"""
    )


@query("i6_merge_clusters", merge_sql(MERGE_LINKS, "arg_max(id, (size, -id))"))
def i6(spark, d):
    return C.person_merge_map(faces(spark, d), k=100, max_distance=0.85)


@query(
    "i7a_merge_capped",
    merge_sql(
        """SELECT a.cluster_id AS src, b.cluster_id AS dst FROM {centroid} a, {centroid} b
           WHERE a.cluster_id <> b.cluster_id AND list_inner_product(a.c, b.c) >= 0.12 AND a.size + b.size <= 55""",
        "min(id)",
    ),
)
def i7a(spark, d):
    return C.merge_capped(faces(spark, d), 0.12, 55)


@query("i7b_merge_multipass")
def i7b(spark, d):
    rows_ = faces(spark, d).where("cluster_id is not null").select("id", "cluster_id", "embedding")
    return C.merge_multipass(rows_, 0.15, tight=0.05, cap=120).select("id", "cluster_id")


# The passes of the run one after the other: seeds, assignment, merge.
FULL = (
    components_sql(KNN_LINKS, "{unit}")
    + ", lab AS MATERIALIZED (SELECT id, cluster_id FROM comp LEFT JOIN dense USING (component)), m1 AS MATERIALIZED "
    + mean_sql("lab", 3)
    + ", placed AS MATERIALIZED "
    + nearest_sql("lab", "m1", "2 * (1 - n.s) < 1.1")
    + ", m2 AS MATERIALIZED "
    + mean_sql("placed", 3)
    + """, near AS MATERIALIZED (SELECT src, dst FROM (SELECT a.cluster_id AS src, b.cluster_id AS dst, list_cosine_similarity(a.c, b.c) AS s,
          row_number() OVER (PARTITION BY a.cluster_id ORDER BY CASE WHEN a.cluster_id = b.cluster_id THEN -2 ELSE -list_cosine_similarity(a.c, b.c) END, b.cluster_id) AS rn
        FROM m2 a, m2 b) WHERE rn <= 10 AND src <> dst AND 1 - s < 0.6),
      two AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near),
      reach2 AS (SELECT cluster_id AS id, cluster_id AS other FROM m2 UNION SELECT r.id, t.dst FROM reach2 r JOIN two t ON t.src = r.other),
      comp2 AS (SELECT id, min(other) AS component FROM reach2 GROUP BY id),
      keep AS (SELECT component, arg_max(id, (size, -id)) AS target FROM comp2 JOIN m2 ON m2.cluster_id = comp2.id GROUP BY component),
      final AS MATERIALIZED (SELECT p.id, coalesce(k.target, p.cluster_id) AS cluster_id FROM placed p
        LEFT JOIN comp2 ON comp2.id = p.cluster_id LEFT JOIN keep k USING (component))"""
)


@query("i17_full_clustering", FULL + " SELECT id, coalesce(cluster_id, -1) AS cluster_id FROM final")
def i17(spark, d):
    run = cluster_faces(
        faces(spark, d), 50, LINK, assign_distance=1.1, merge_distance=0.6, band=(0.3, LINK + 0.05)
    )
    return run.faces.select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query(
    "i17_full_clustering_suggestions",
    FULL
    + """, fu AS MATERIALIZED (SELECT u.id, f.cluster_id, u.u FROM {unit} u JOIN final f ON f.id = u.id),
      b AS (SELECT face_id, suggested_cluster_id, distance, 'boundary_noise' AS reason FROM (
        SELECT a.id AS face_id, b.cluster_id AS suggested_cluster_id, 1 - list_inner_product(a.u, b.u) AS distance,
          row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_inner_product(a.u, b.u), b.id) AS rn
        FROM fu a, fu b WHERE a.cluster_id IS NULL AND b.cluster_id IS NOT NULL) WHERE rn = 1 AND distance BETWEEN 0.3 AND 0.65),
      um AS (SELECT cluster_id, list(x ORDER BY i) AS m FROM (
        SELECT cluster_id, i, avg(x) AS x FROM (SELECT cluster_id, unnest(u) AS x, unnest(range(0, len(u))) AS i FROM fu WHERE cluster_id IS NOT NULL)
        GROUP BY cluster_id, i HAVING count(*) >= 5) GROUP BY cluster_id),
      d AS (SELECT fu.id, fu.cluster_id, 1 - list_inner_product(fu.u, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m)))) AS distance
        FROM fu JOIN um ON um.cluster_id = fu.cluster_id),
      o AS (SELECT id AS face_id, cluster_id AS suggested_cluster_id, distance, 'cluster_outlier' AS reason FROM (
        SELECT *, quantile_cont(distance, 0.75) OVER (PARTITION BY cluster_id) AS p75 FROM d) WHERE distance > p75 AND distance > 0.2)
    SELECT face_id, suggested_cluster_id, round(distance, 6) AS distance, reason, 'pending' AS status FROM (FROM b UNION ALL FROM o)""",
)
def i17_suggestions(spark, d):
    run = cluster_faces(
        faces(spark, d), 50, LINK, assign_distance=1.1, merge_distance=0.6, band=(0.3, LINK + 0.05)
    )
    return run.suggestions.withColumn("distance", F.round("distance", 6))


@query(
    "e8_dense_labels",
    """SELECT label AS component, row_number() OVER (ORDER BY m) - 1 AS cluster_id FROM (SELECT label * 3 AS label, label AS m FROM {faces} GROUP BY label)""",
)
def e8(spark, d):
    parts = faces(spark, d).select("id", (F.col("label") * 3).alias("component"))
    return C.dense_labels(parts)


@query(
    "e9_offset_ids",
    """SELECT id, CASE WHEN species = 'cat' THEN coalesce(cluster_id + 10000, -1) ELSE coalesce(cluster_id, -1) END AS cluster_id FROM {faces}""",
)
def e9(spark, d):
    labels = faces(spark, d).select(
        "id", "species", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id")
    )
    dogs = labels.where(F.col("species") == "dog")
    cats = C.offset_ids(labels.where(F.col("species") == "cat"))
    return dogs.unionByName(cats).select("id", "cluster_id")


@query(
    "e8_cluster_names",
    "SELECT DISTINCT cluster_id, 'Dog ' || (cluster_id + 1) AS display_name FROM {faces} WHERE cluster_id IS NOT NULL",
)
def e8_names(spark, d):
    found = faces(spark, d).where("cluster_id is not null").select("cluster_id").distinct()
    return C.cluster_names(found, "Dog ", first=1)
