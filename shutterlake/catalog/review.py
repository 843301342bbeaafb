"""Queries over the review loop: suggestions and decisions as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.catalog.core import (
    clusters,
    decisions,
    faces,
    media,
    query,
    suggestions,
    table,
    timeline,
)
from shutterlake.operators import review as R

BOUNDARY = """SELECT face_id, suggested_cluster_id, distance FROM (
  SELECT a.id AS face_id, b.cluster_id AS suggested_cluster_id, 1 - list_inner_product(a.u, b.u) AS distance,
    row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_inner_product(a.u, b.u), b.id) AS rn
  FROM {unit} a, {unit} b WHERE a.cluster_id IS NULL AND b.cluster_id IS NOT NULL)
  WHERE rn = 1 AND distance >= 0.55 AND distance <= 0.65"""

OUTLIERS = """SELECT id AS face_id, cluster_id AS suggested_cluster_id, distance FROM (
  SELECT *, quantile_cont(distance, 0.75) OVER (PARTITION BY cluster_id) AS p75 FROM (
    SELECT u.id, u.cluster_id, 1 - list_inner_product(u.u, c.c) AS distance FROM {unit} u JOIN (
      SELECT cluster_id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM (
        SELECT cluster_id, list(x ORDER BY i) AS m FROM (
          SELECT cluster_id, i, avg(x) AS x FROM (SELECT cluster_id, unnest(u) AS x, unnest(range(0, len(u))) AS i FROM {unit} WHERE cluster_id IS NOT NULL)
          GROUP BY cluster_id, i) GROUP BY cluster_id)) c ON c.cluster_id = u.cluster_id
    JOIN {clusters} k ON k.id = u.cluster_id AND NOT k.is_hidden))
  WHERE distance > p75 AND distance > 0.2"""


@query("i14_boundary_suggestions", f"SELECT face_id, suggested_cluster_id, round(distance, 6) AS distance FROM ({BOUNDARY})")
def i14(spark, d):
    out = R.boundary_suggestions(faces(spark, d), (0.55, 0.65), limit=None)
    return out.select("face_id", "suggested_cluster_id", F.round("distance", 6).alias("distance"))


@query("i15_outlier_suggestions", f"SELECT face_id, suggested_cluster_id, round(distance, 6) AS distance FROM ({OUTLIERS})")
def i15(spark, d):
    out = R.outlier_suggestions(faces(spark, d), clusters(spark, d), limit=None)
    return out.select("face_id", "suggested_cluster_id", F.round("distance", 6).alias("distance"))


@query(
    "f9_capped_suggestions",
    f"""WITH b AS (SELECT face_id, 'boundary_noise' AS reason FROM ({BOUNDARY}) ORDER BY face_id LIMIT 60),
         o AS (SELECT face_id, 'cluster_outlier' AS reason, row_number() OVER (ORDER BY suggested_cluster_id, face_id) AS rn FROM ({OUTLIERS}))
       SELECT * FROM b UNION ALL SELECT face_id, reason FROM o WHERE rn <= 60 - (SELECT count(*) FROM b)""",
)
def f9(spark, d):
    out = R.new_suggestions(faces(spark, d), clusters(spark, d), 60, band=(0.55, 0.65))
    return out.select("face_id", "reason")


@query(
    "i16_refresh_suggestions",
    f"""SELECT face_id, suggested_cluster_id, status FROM {{suggestions}} WHERE status <> 'pending'
        UNION ALL SELECT face_id, suggested_cluster_id, 'pending' FROM ({BOUNDARY})""",
)
def i16(spark, d):
    new = R.boundary_suggestions(faces(spark, d), (0.55, 0.65), limit=None)
    out = R.refresh_suggestions(suggestions(spark, d), new)
    return out.select("face_id", "suggested_cluster_id", "status")


@query(
    "c8_pending_queue",
    """WITH p AS (SELECT * FROM {suggestions} WHERE status = 'pending' ORDER BY distance DESC, id LIMIT 40)
       SELECT p.id, p.face_id, p.suggested_cluster_id, coalesce(c.display_name, 'Person ' || c.id) AS person_name,
         round(p.distance, 6) AS distance, p.reason, coalesce(s.l, '') AS sample_faces
       FROM p JOIN {clusters} c ON c.id = p.suggested_cluster_id JOIN {faces} f ON f.id = p.face_id
       LEFT JOIN (SELECT cluster_id, array_to_string(list(id ORDER BY id)[1:5], '|') AS l FROM {faces} WHERE cluster_id IS NOT NULL GROUP BY 1) s
         ON s.cluster_id = p.suggested_cluster_id""",
)
def c8(spark, d):
    q = R.pending_queue(suggestions(spark, d), faces(spark, d), clusters(spark, d), 40)
    samples = F.array_join(F.col("sample_faces").cast("array<string>"), "|")
    return q.select(
        "id", "face_id", "suggested_cluster_id", "person_name",
        F.round("distance", 6).alias("distance"), "reason",
        F.coalesce(samples, F.lit("")).alias("sample_faces"),
    )


@query(
    "j1_accept",
    """SELECT f.id, coalesce(a.suggested_cluster_id, f.cluster_id, -1) AS cluster_id FROM {faces} f LEFT JOIN
         (SELECT s.face_id, arg_max(s.suggested_cluster_id, l.reviewed_at) AS suggested_cluster_id FROM {decisions} l JOIN {suggestions} s ON s.id = l.suggestion_id WHERE l.action = 'accept' GROUP BY s.face_id) a
         ON a.face_id = f.id""",
)
def j1(spark, d):
    moved = R.accept_suggestions(
        faces(spark, d).select("id", "cluster_id"), suggestions(spark, d), decisions(spark, d)
    )
    return moved.select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query(
    "j1_j2_j3_statuses",
    """SELECT s.id, coalesce(CASE l.action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'skip' THEN 'skipped' END, s.status) AS status,
         l.reviewed_at FROM {suggestions} s LEFT JOIN {latest} l ON l.suggestion_id = s.id""",
)
def j3(spark, d):
    out = R.decide_suggestions(suggestions(spark, d), decisions(spark, d))
    return out.select("id", "status", "reviewed_at")


@query(
    "j2_reject_into_new_cluster",
    """SELECT f.id, coalesce(n.new_id, f.cluster_id, -1) AS cluster_id FROM {faces} f LEFT JOIN (
         SELECT id, (SELECT max(id) FROM {clusters}) + row_number() OVER (ORDER BY id) AS new_id FROM {faces} WHERE cluster_id IS NULL AND id IN (
           SELECT s.face_id FROM {decisions} l JOIN {suggestions} s ON s.id = l.suggestion_id WHERE l.action = 'reject' AND l.create_new
             AND NOT EXISTS (SELECT 1 FROM {decisions} e WHERE e.suggestion_id = l.suggestion_id AND e.action = 'accept' AND e.reviewed_at <= l.reviewed_at))) n ON n.id = f.id""",
)
def j2(spark, d):
    moved, _ = R.reject_into_new_clusters(
        faces(spark, d).select("id", "cluster_id"), clusters(spark, d), suggestions(spark, d),
        decisions(spark, d),
    )
    return moved.select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


REQUESTS = """SELECT face_id, cluster_id FROM (
  SELECT owner * 3 AS face_id, CASE WHEN event_type = 'error' THEN -1 ELSE k END::BIGINT AS cluster_id, row_number() OVER (PARTITION BY owner ORDER BY ts DESC) AS rn FROM {timeline}) WHERE rn = 1"""


def requests(spark, d):
    return timeline(spark, d).select(
        (F.col("owner") * 3).alias("face_id"),
        F.when(F.col("event_type") == "error", -1)
        .otherwise(F.col("k"))
        .cast("long")
        .alias("cluster_id"),
        F.col("ts").alias("reviewed_at"),
    )


@query(
    "j4_assign_faces",
    f"""SELECT f.id, coalesce(r.cluster_id, f.cluster_id, -1) AS cluster_id FROM {{faces}} f LEFT JOIN
          (SELECT * FROM ({REQUESTS}) WHERE cluster_id >= 0) r ON r.face_id = f.id""",
)
def j4(spark, d):
    moved, _ = R.assign_faces(
        faces(spark, d).select("id", "cluster_id"), clusters(spark, d), requests(spark, d)
    )
    return moved.select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query(
    "j4_assign_errors",
    f"""SELECT face_id, cluster_id, CASE WHEN face_id NOT IN (SELECT id FROM {{faces}}) THEN 'face not found' ELSE 'cluster not found' END AS error
        FROM ({REQUESTS}) WHERE cluster_id < 0 OR face_id NOT IN (SELECT id FROM {{faces}})""",
)
def j4_errors(spark, d):
    _, errors = R.assign_faces(
        faces(spark, d).select("id", "cluster_id"), clusters(spark, d), requests(spark, d)
    )
    return errors


def merge_requests(spark, d):
    """Every customer merges into the one numbered like its nation."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("source"), F.col("c_nationkey").cast("long").alias("target")
    )


# Every request points at one of the first 25 clusters, so chains are closed
# among those and the rest follow their target. The survivor is the smallest
# cluster of a component that is itself no source.
RESOLVED = """
  WITH RECURSIVE e AS MATERIALIZED (SELECT c_custkey AS s, c_nationkey::BIGINT AS t FROM customer WHERE c_custkey <> c_nationkey),
    b AS (SELECT s, t FROM e WHERE s IN (SELECT t FROM e) UNION SELECT t, s FROM e WHERE s IN (SELECT t FROM e)),
    r AS (SELECT DISTINCT t AS id, t AS o FROM e UNION SELECT r.id, b.t FROM r JOIN b ON b.s = r.o),
    root AS (SELECT id, min(o) AS comp FROM r GROUP BY id),
    c AS (SELECT k.id, coalesce(own.comp, via.comp, k.id) AS comp FROM {clusters} k
          LEFT JOIN root own ON own.id = k.id LEFT JOIN e ON e.s = k.id LEFT JOIN root via ON via.id = e.t),
    k AS (SELECT comp, coalesce(min(id) FILTER (id NOT IN (SELECT s FROM e)), min(id)) AS target FROM c GROUP BY comp),
    m AS (SELECT c.id AS source, k.target FROM c JOIN k ON k.comp = c.comp WHERE c.id <> k.target)"""


@query(
    "j5_merge_members",
    RESOLVED
    + " SELECT f.id, coalesce(m.target, f.cluster_id, -1) AS cluster_id FROM {faces} f LEFT JOIN m ON m.source = f.cluster_id",
)
def j5(spark, d):
    return merged(spark, d)[0].select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query("j5_merge_events", RESOLVED + " SELECT source AS source_cluster_id, target AS target_cluster_id, 'user' AS initiated_by FROM m")
def j5_events(spark, d):
    return merged(spark, d)[2].select("source_cluster_id", "target_cluster_id", "initiated_by")


@query("j5_merge_clusters_left", RESOLVED + " SELECT id FROM {clusters} WHERE id NOT IN (SELECT source FROM m)")
def j5_left(spark, d):
    return merged(spark, d)[1].select("id")


@query(
    "j5_merge_errors",
    "SELECT c_custkey AS source, c_nationkey::BIGINT AS target, 'target among sources' AS error FROM customer WHERE c_custkey = c_nationkey",
)
def j5_errors(spark, d):
    return R.resolve_merges(merge_requests(spark, d), clusters(spark, d))[1]


def merged(spark, d):
    mapping, _ = R.resolve_merges(merge_requests(spark, d), clusters(spark, d))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return R.merge_with_audit(
        faces(spark, d).select("id", "cluster_id"), clusters(spark, d), mapping, "user", at
    )


@query(
    "b12_j6_update_fields",
    """SELECT id, CASE WHEN s_suppkey % 4 = 0 THEN 'again ' || s_name WHEN s_name IS NOT NULL THEN 'renamed ' || s_name ELSE display_name END AS display_name,
         CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_name ELSE description END AS description, is_hidden
       FROM {clusters} LEFT JOIN supplier ON s_suppkey * 3 = id""",
)
def j6(spark, d):
    rows = table(spark, d, "supplier")
    key = (F.col("s_suppkey") * 3).cast("long").alias("id")
    first = rows.select(
        key,
        F.concat(F.lit("renamed "), "s_name").alias("display_name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(1).cast("long").alias("primary_id"),
        F.lit(None).cast("boolean").alias("is_hidden"),
        F.lit(1).alias("at"),
    )
    second = rows.where(F.col("s_suppkey") % 2 == 0).select(
        key,
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("again "), "s_name")).alias("display_name"),
        F.concat(F.lit("about "), "s_name").alias("description"),
        F.lit(2).cast("long").alias("primary_id"),
        F.lit(None).cast("boolean").alias("is_hidden"),
        F.lit(2).alias("at"),
    )
    out = R.update_fields(clusters(spark, d), first.unionByName(second), time="at")
    return out.select("id", "display_name", "description", "is_hidden")


@query("j7_soft_delete", "SELECT media_id, lang = 'de' AS is_missing FROM {media}")
def j7(spark, d):
    return deleted(spark, d)[0].select("media_id", "is_missing")


@query(
    "j7_delete_log",
    "SELECT media_id, path AS original_path, '/trash/' || substr(path, 10) AS trash_path, mtime AS deleted_at, 's1' AS session_id FROM {media} WHERE lang = 'de'",
)
def j7_log(spark, d):
    return deleted(spark, d)[1]


def deleted(spark, d):
    m = media(spark, d).select("media_id", "path", "lang", "mtime")
    asked = m.where(F.col("lang") == "de").select("media_id", F.col("mtime").alias("deleted_at"))
    return R.soft_delete(
        m.withColumn("is_missing", F.lit(False)), asked, "/library", "/trash", "s1"
    )


@query("g1_suggestion_union", "SELECT reason, count(*) AS n FROM {suggestions} GROUP BY reason")
def g1_suggestions(spark, d):
    s = suggestions(spark, d)
    a = s.where(F.col("reason") == "boundary_noise")
    b = s.where(F.col("reason") == "cluster_outlier")
    return a.unionByName(b).groupBy("reason").agg(F.count("*").alias("n"))
