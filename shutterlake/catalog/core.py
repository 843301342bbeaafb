"""Query registration and the media-shaped views over the given tables.

Every view exists twice, as a DataFrame and as a SQL text, and keeps all rows of
the table it is derived from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import media as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name; `{view}` in the SQL names a view to include."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    used: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if "{" + v + "}" in text and v not in used:
                need(VIEWS[v])
                if v not in used:
                    used.append(v)

    need(sql)
    ctes = [f"v_{v} AS ({_plain(VIEWS[v])})" for v in used]
    body = _plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE ") :]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH ") :]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _plain(sql: str) -> str:
    for v in VIEWS:
        sql = sql.replace("{" + v + "}", f"v_{v}")
    return sql


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


EXT = [".jpg", ".JPG", ".png", ".heic", ".mp4", ".MOV", ".txt"]

# Approximate places are built from a small number k: a 10 x 10 grid of points
# 0.004 degrees apart.
VIEWS = {
    "media": """
        SELECT doc_id AS media_id,
          '/library/' || source || '/' || CASE WHEN lang = 'fr' THEN 'Unknown' ELSE lang END || '/'
            || 'IMG_' || n_chars || '_' || doc_id
            || ['.jpg','.JPG','.png','.heic','.mp4','.MOV','.txt'][(n_chars % 7 + 1)::INT] AS path,
          'IMG_' || n_chars
            || ['.jpg','.JPG','.png','.heic','.mp4','.MOV','.txt'][(n_chars % 7 + 1)::INT] AS name,
          source, lang, text,
          CASE WHEN n_chars >= 40 THEN sha256(text) END AS sha256,
          strlen(text)::BIGINT AS size_bytes,
          (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS resolution,
          CASE WHEN lang <> 'fr' THEN TIMESTAMP '2021-01-01' + to_hours(n_chars::INT) END AS ts,
          TIMESTAMP '2022-01-01' + to_minutes(n_chars::INT) AS mtime,
          CASE WHEN lang = 'es' THEN 40 + (n_chars % 10) * 0.004::DOUBLE END AS lat,
          CASE WHEN lang = 'es' THEN -74 + (n_chars // 10 % 10) * 0.004::DOUBLE END AS lon
        FROM documents""",
    "tree": """
        SELECT media_id, sha256, ts, size_bytes,
          '/organized/' || source || '/' || lang || '/'
            || CASE WHEN resolution <= 8 THEN 'Unknown' ELSE 'album' END || '/IMG_' || media_id
            || '.jpg' AS path
        FROM {media}""",
    "plan": """
        SELECT sha256, keep, path AS duplicate, keep_score,
          resolution * 1000 + size_bytes AS delete_score, size_bytes, source
        FROM (
          SELECT *,
            first_value(path) OVER w AS keep,
            first_value(resolution * 1000 + size_bytes) OVER w AS keep_score,
            row_number() OVER w AS rn
          FROM {media} WHERE sha256 IS NOT NULL
          WINDOW w AS (PARTITION BY sha256 ORDER BY resolution DESC, mtime, length(path), path))
        WHERE rn > 1""",
    "pairs": "SELECT keep AS original, duplicate FROM {plan}",
    "manifest": """
        SELECT path, sha256, size_bytes FROM {media} WHERE resolution > 3""",
    "checked": """
        SELECT p.original, p.duplicate,
          o.path IS NOT NULL AS original_exists, d.path IS NOT NULL AS duplicate_exists,
          o.sha256 AS original_sha256, o.size_bytes AS original_bytes,
          d.sha256 AS duplicate_sha256, d.size_bytes AS duplicate_bytes,
          o.sha256 = d.sha256 AS hashes_match
        FROM {pairs} p LEFT JOIN {manifest} o ON o.path = p.original
        LEFT JOIN {manifest} d ON d.path = p.duplicate""",
    "signature": """
        SELECT doc_id AS media_id,
          bit_or(CASE WHEN n * 64 >= total THEN
            CASE WHEN b = 0 THEN (-9223372036854775807 - 1)::BIGINT ELSE 1::BIGINT << (63 - b) END
            ELSE 0::BIGINT END) AS phash
        FROM (
          SELECT doc_id, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total
          FROM (SELECT doc_id, (length(word) * 7 + ascii(word) * 3 + ascii(right(word, 1))) % 64 AS b
                FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents))
          GROUP BY doc_id, b)
        GROUP BY doc_id""",
    "timeline": """
        SELECT event_id AS media_id, user_id AS owner, ts, value, event_type, k,
          CASE WHEN event_type NOT IN ('error', 'signup') THEN 40 + (k % 10) * 0.004::DOUBLE END AS lat,
          CASE WHEN event_type NOT IN ('error', 'signup') THEN -74 + (k // 10) * 0.004::DOUBLE END AS lon,
          CASE WHEN event_type = 'purchase' THEN 'Place ' || k END AS location_name
        FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)""",
    "faces": """
        SELECT vec_id AS id, vec_id // 2 AS media_id, (vec_id % 2)::INT AS embedding_index,
          embedding::DOUBLE[] AS embedding, label::BIGINT AS label,
          CASE WHEN embedding[1] >= 0 THEN label::BIGINT END AS cluster_id,
          CASE WHEN label % 2 = 0 THEN 'dog' ELSE 'cat' END AS species,
          CASE WHEN embedding[2] >= 0 THEN 'thumbs/' || vec_id || '.jpg' END AS thumbnail_path,
          abs(embedding[3]::DOUBLE) * 4 AS confidence,
          CASE WHEN label = 9 THEN 'clip' ELSE 'adaface' END AS model_name,
          embedding[4] > 0.2 AS is_pet
        FROM embeddings""",
    "clusters": """
        SELECT c_custkey AS id,
          CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name END AS display_name,
          'from ' || c_mktsegment AS description,
          CASE WHEN c_acctbal < 0 THEN c_custkey * 7 END AS primary_id,
          c_mktsegment = 'FURNITURE' AS is_hidden
        FROM customer""",
    "suggestions": """
        SELECT id + 1000 AS id, id AS face_id, label AS suggested_cluster_id,
          abs(embedding[5]) AS distance,
          CASE WHEN embedding[6] >= 0 THEN 'boundary_noise' ELSE 'cluster_outlier' END AS reason,
          CASE WHEN embedding[7] < -0.1 THEN 'pending' WHEN embedding[7] < 0 THEN 'accepted'
            WHEN embedding[7] < 0.1 THEN 'rejected' ELSE 'skipped' END AS status,
          NULL::TIMESTAMP AS reviewed_at
        FROM {faces}""",
    "decisions": """
        SELECT k::BIGINT + 1000 AS suggestion_id,
          CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'accept'
            WHEN 'error' THEN 'skip' ELSE 'reject' END AS action,
          ts AS reviewed_at, event_type = 'signup' AS create_new
        FROM {timeline}""",
    "latest": """
        SELECT suggestion_id, action, reviewed_at, create_new FROM (
          SELECT *, row_number() OVER (PARTITION BY suggestion_id ORDER BY reviewed_at DESC) AS rn
          FROM {decisions}) WHERE rn = 1""",
    "place_cache": """
        SELECT DISTINCT
          round(40 + (p_size % 10) * 0.004::DOUBLE, 3)::VARCHAR || ',' ||
          round(-74 + (p_size // 10) * 0.004::DOUBLE, 3)::VARCHAR AS key,
          'Street ' || p_size || ', Town' AS address
        FROM part WHERE p_size < 40""",
    "unit": """
        SELECT id, label, cluster_id, species, thumbnail_path,
          list_transform(embedding, lambda x: x / n) AS u
        FROM (SELECT *, sqrt(list_inner_product(embedding, embedding)) AS n FROM {faces})""",
    "dims": """
        SELECT id, label, cluster_id, unnest(embedding) AS x,
          unnest(range(1, len(embedding) + 1)) AS i
        FROM {faces}""",
    "centroid": """
        SELECT cluster_id, size,
          list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c
        FROM (SELECT cluster_id, max(n) AS size, list(x ORDER BY i) AS m
              FROM (SELECT cluster_id, i, avg(x) AS x, count(*) AS n
                    FROM {dims} WHERE cluster_id IS NOT NULL GROUP BY cluster_id, i)
              GROUP BY cluster_id)""",
    "label_centroid": """
        SELECT label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c
        FROM (SELECT label, list(x ORDER BY i) AS m
              FROM (SELECT label, i, avg(x) AS x FROM {dims} GROUP BY label, i)
              GROUP BY label)""",
}


def media(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    n = F.col("n_chars")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT]), (n % 7 + 1).cast("int"))
    folder = F.when(F.col("lang") == "fr", "Unknown").otherwise(F.col("lang"))
    spanish = F.col("lang") == "es"
    out = t.select(
        F.col("doc_id").alias("media_id"),
        F.concat(
            F.lit("/library/"), "source", F.lit("/"), folder, F.lit("/IMG_"), n, F.lit("_"),
            "doc_id", ext,
        ).alias("path"),
        F.concat(F.lit("IMG_"), n, ext).alias("name"),
        "source",
        "lang",
        "text",
        F.when(n >= 40, M.content_hash(F.col("text"))).alias("sha256"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
        .cast("long")
        .alias("resolution"),
        F.when(
            F.col("lang") != "fr",
            F.lit("2021-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), n.cast("int")),
        ).alias("ts"),
        (
            F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))
        ).alias("mtime"),
        F.when(spanish, 40 + (n % 10) * F.lit(0.004)).alias("lat"),
        F.when(spanish, -74 + (F.floor(n / 10) % 10) * F.lit(0.004)).alias("lon"),
    )
    return out.withColumn("gps", M.gps(F.col("lat"), F.col("lon")))


def tree(spark: SparkSession, d: str) -> DataFrame:
    sub = F.when(F.col("resolution") <= 8, "Unknown").otherwise("album")
    return media(spark, d).select(
        "media_id",
        "sha256",
        "ts",
        "size_bytes",
        F.concat(
            F.lit("/organized/"), "source", F.lit("/"), "lang", F.lit("/"), sub, F.lit("/IMG_"),
            "media_id", F.lit(".jpg"),
        ).alias("path"),
    )


def signature(spark: SparkSession, d: str) -> DataFrame:
    """A 64-bit average hash over word-bucket counts, standing in for grey values."""
    words = table(spark, d, "documents").select(
        F.col("doc_id").alias("media_id"), F.explode(F.split("text", " ")).alias("w")
    )
    bucket = (F.length("w") * 7 + F.ascii("w") * 3 + F.ascii(F.right("w", F.lit(1)))) % 64
    # In one step, as a split holds whole documents: counters per (document, bucket) first would be
    # dealt by both, and every task after that would hold 64 columns of nearly every document.
    counts = words.select("media_id", bucket.alias("b")).groupBy("media_id").agg(
        *[F.sum(F.when(F.col("b") == i, 1).otherwise(0)).alias(f"p{i}") for i in range(64)]
    )
    return counts.select("media_id", F.array(*[f"p{i}" for i in range(64)]).alias("pixels"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return signature(spark, d).select("media_id", M.average_hash64(F.col("pixels")).alias("phash"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    placed = ~F.col("event_type").isin("error", "signup")
    t = table(spark, d, "events").withColumn("k", k)
    out = t.select(
        F.col("event_id").alias("media_id"),
        F.col("user_id").alias("owner"),
        "ts",
        "value",
        "event_type",
        "k",
        F.when(placed, 40 + (F.col("k") % 10) * F.lit(0.004)).alias("lat"),
        F.when(placed, -74 + F.floor(F.col("k") / 10) * F.lit(0.004)).alias("lon"),
        F.when(
            F.col("event_type") == "purchase", F.concat(F.lit("Place "), F.col("k"))
        ).alias("location_name"),
    )
    return out.withColumn("gps", M.gps(F.col("lat"), F.col("lon")))


def place_cache(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_size")
    return (
        table(spark, d, "part")
        .where(p < 40)
        .select(
            M.location_key(40 + (p % 10) * F.lit(0.004), -74 + F.floor(p / 10) * F.lit(0.004)).alias(
                "key"
            ),
            F.concat(F.lit("Street "), p, F.lit(", Town")).alias("address"),
        )
        .distinct()
    )


def faces(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")

    def at(i: int) -> Column:
        return F.get(e, i - 1)

    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.floor(F.col("vec_id") / 2).alias("media_id"),
        (F.col("vec_id") % 2).cast("int").alias("embedding_index"),
        "embedding",
        F.col("label").cast("long").alias("label"),
        F.when(at(1) >= 0, F.col("label").cast("long")).alias("cluster_id"),
        F.when(F.col("label") % 2 == 0, "dog").otherwise("cat").alias("species"),
        F.when(at(2) >= 0, F.concat(F.lit("thumbs/"), "vec_id", F.lit(".jpg"))).alias(
            "thumbnail_path"
        ),
        (F.abs(at(3).cast("double")) * 4).alias("confidence"),
        F.when(F.col("label") == 9, "clip").otherwise("adaface").alias("model_name"),
        (at(4) > 0.2).alias("is_pet"),
    )


def clusters(spark: SparkSession, d: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        key.alias("id"),
        F.when(segment != "MACHINERY", F.col("c_name")).alias("display_name"),
        F.concat(F.lit("from "), segment).alias("description"),
        F.when(F.col("c_acctbal") < 0, key * 7).alias("primary_id"),
        (segment == "FURNITURE").alias("is_hidden"),
    )


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    s = F.get(e, 6)
    return faces(spark, d).select(
        (F.col("id") + 1000).alias("id"),
        F.col("id").alias("face_id"),
        F.col("label").alias("suggested_cluster_id"),
        F.abs(F.get(e, 4).cast("double")).alias("distance"),
        F.when(F.get(e, 5) >= 0, "boundary_noise").otherwise("cluster_outlier").alias("reason"),
        F.when(s < -0.1, "pending")
        .when(s < 0, "accepted")
        .when(s < 0.1, "rejected")
        .otherwise("skipped")
        .alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
    )


def decisions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return timeline(spark, d).select(
        (F.col("k").cast("long") + 1000).alias("suggestion_id"),
        F.when(kind.isin("click", "purchase"), "accept")
        .when(kind == "error", "skip")
        .otherwise("reject")
        .alias("action"),
        F.col("ts").alias("reviewed_at"),
        (kind == "signup").alias("create_new"),
    )


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).where(F.col("resolution") > 3).select("path", "sha256", "size_bytes")
