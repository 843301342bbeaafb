"""Queries over clusters, members and reports about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.catalog.core import clusters, faces, media, query, suggestions, table, timeline
from shutterlake.catalog.files import scratch
from shutterlake.functions import media as M
from shutterlake.operators import dedup as D
from shutterlake.operators import ingest as I
from shutterlake.operators import review as R
from shutterlake.operators import stats as S
from shutterlake.sources import reports as O

# ---- tables and resets ----------------------------------------------------------


@query("a12_entity_table", "SELECT id, media_id, coalesce(cluster_id, -1) AS cluster_id, species FROM {faces}")
def a12(spark, d):
    """Faces written as a table version and read back from it."""
    base = scratch(spark)
    path = O.write_table(faces(spark, d), base, "1")
    return spark.read.parquet(path).select(
        "id", "media_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "species"
    )


@query("a19_reset_clusters", "SELECT count(*) AS n_rows, 0::BIGINT AS n_clustered FROM {faces}")
def a19(spark, d):
    return O.reset_clusters(faces(spark, d)).agg(
        F.count("*").alias("n_rows"), F.count("cluster_id").alias("n_clustered")
    )


@query("a19_without_species", "SELECT id, species FROM {faces} WHERE species <> 'cat'")
def a19_species(spark, d):
    return O.without_species(faces(spark, d), "cat").select("id", "species")


# ---- predicates -------------------------------------------------------------------


@query(
    "b5_clustered_split",
    "SELECT cluster_id IS NULL AS is_noise, count(*) AS n FROM {faces} GROUP BY 1",
)
def b5(spark, d):
    return faces(spark, d).groupBy(F.col("cluster_id").isNull().alias("is_noise")).agg(
        F.count("*").alias("n")
    )


@query("b6_b7_species_with_thumbnail", "SELECT id FROM {faces} WHERE species = 'dog' AND thumbnail_path IS NOT NULL")
def b6(spark, d):
    keep = (F.col("species") == "dog") & F.col("thumbnail_path").isNotNull()
    return faces(spark, d).where(keep).select("id")


@query("b14_name_search", "SELECT id FROM {clusters} WHERE contains(lower(coalesce(display_name, 'unknown')), '00001')")
def b14(spark, d):
    return R.name_search(clusters(spark, d), "00001").select("id")


@query("b15_visible_clusters", "SELECT id, description FROM {clusters} WHERE NOT is_hidden")
def b15(spark, d):
    return clusters(spark, d).where(~F.col("is_hidden")).select("id", "description")


@query(
    "b17_without_pet_clusters",
    """SELECT id FROM {clusters} WHERE id NOT IN (SELECT cluster_id FROM (
         SELECT cluster_id, is_pet, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn
         FROM {faces} WHERE cluster_id IS NOT NULL) WHERE rn <= 5 GROUP BY cluster_id HAVING bool_or(is_pet))""",
)
def b17(spark, d):
    return R.without_pet_clusters(clusters(spark, d), faces(spark, d)).select("id")


# ---- listings -----------------------------------------------------------------------


@query(
    "c7_cluster_listing",
    """SELECT c.id, coalesce(c.display_name, 'Person ' || c.id) AS name, coalesce(n, 0)::BIGINT AS n_members FROM {clusters} c
       LEFT JOIN (SELECT cluster_id, count(*) AS n FROM {faces} WHERE cluster_id IS NOT NULL GROUP BY 1) f ON f.cluster_id = c.id""",
)
def c7(spark, d):
    listed = R.cluster_listing(clusters(spark, d), faces(spark, d))
    name = M.display_name(F.col("display_name"), F.col("id"))
    return listed.select("id", name.alias("name"), "n_members")


@query(
    "c7_customer_orders",
    "SELECT c_custkey AS id, count(o_orderkey) AS n_members FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def c7_orders(spark, d):
    """The same listing on the larger parent/child pair of tables."""
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    children = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id"))
    return R.cluster_listing(parents, children)


@query(
    "c23_members_with_path",
    """SELECT f.id, coalesce(m.path, '') AS path, m.path IS NULL AS failed FROM {faces} f LEFT JOIN
         (SELECT * FROM {media} WHERE sha256 IS NOT NULL) m ON m.media_id = f.media_id * 3""",
)
def c23(spark, d):
    members = faces(spark, d).select("id", (F.col("media_id") * 3).alias("media_id"))
    joined = I.with_media_path(members, media(spark, d).where(F.col("sha256").isNotNull()))
    return joined.select("id", F.coalesce("path", F.lit("")).alias("path"), "failed")


@query(
    "e6_first_members",
    """SELECT o_custkey AS cluster_id, o_orderkey AS id FROM (
         SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 5""",
)
def e6(spark, d):
    members = table(spark, d, "orders").select(
        F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("id")
    )
    return D.first_per_group(members, ["cluster_id"], [F.col("id").asc()], 5)


@query(
    "e7_covers",
    """SELECT c.id, coalesce(c.primary_id, t, m, -1) AS cover_id FROM {clusters} c LEFT JOIN (
         SELECT cluster_id, min(id) FILTER (thumbnail_path IS NOT NULL) AS t, min(id) AS m FROM {faces}
         WHERE cluster_id IS NOT NULL GROUP BY 1) f ON f.cluster_id = c.id""",
)
def e7(spark, d):
    found = R.covers(clusters(spark, d), faces(spark, d))
    return found.select("id", F.coalesce("cover_id", F.lit(-1)).alias("cover_id"))


@query("f1_unclustered_page", "SELECT id FROM {faces} WHERE cluster_id IS NULL ORDER BY id LIMIT 50 OFFSET 20")
def f1(spark, d):
    return R.page(faces(spark, d).where("cluster_id is null").select("id"), ["id"], 50, 20)


@query(
    "f1_page_info",
    """SELECT count(*) AS total, greatest(0, least(50, count(*) - 20))::BIGINT AS n_rows,
         20 + greatest(0, least(50, count(*) - 20)) < count(*) AS has_more FROM {faces} WHERE cluster_id IS NULL""",
)
def f1_info(spark, d):
    return R.page_info(faces(spark, d).where("cluster_id is null"), 50, 20)


@query(
    "f3_order_by_size",
    """SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS position FROM (SELECT label, count(*) AS n FROM {faces} GROUP BY label)""",
)
def f3(spark, d):
    from shutterlake.operators.ordering import number_rows

    sizes = faces(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return number_rows(sizes, [], [F.desc("n"), F.col("label").asc()], "position")


@query("f5_first_n", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 200")
def f5(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").limit(200).select("event_id")


# ---- statistics ----------------------------------------------------------------------

SIZES = "SELECT cluster_id, count(*) AS size FROM {faces} WHERE cluster_id IS NOT NULL GROUP BY cluster_id"


@query(
    "d16_size_stats",
    f"""SELECT count(*) AS n_clusters, sum(size)::BIGINT AS n_members, max(size) AS largest, min(size) AS smallest,
          round(avg(size), 6) AS mean_size, median(size) AS median_size FROM ({SIZES})""",
)
def d16(spark, d):
    return S.size_stats(faces(spark, d)).withColumn("mean_size", F.round("mean_size", 6))


@query(
    "d16_customer_size_stats",
    """SELECT count(*) AS n_clusters, sum(size)::BIGINT AS n_members, max(size) AS largest, min(size) AS smallest,
          round(avg(size), 6) AS mean_size, median(size) AS median_size
       FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1)""",
)
def d16_orders(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id"))
    return S.size_stats(labels).withColumn("mean_size", F.round("mean_size", 6))


@query("d17_size_frequency", f"SELECT size, count(*) AS n_clusters FROM ({SIZES}) GROUP BY size")
def d17(spark, d):
    return S.size_frequency(faces(spark, d))


@query("d18_top_clusters", f"SELECT cluster_id, size FROM ({SIZES}) ORDER BY size DESC, cluster_id LIMIT 10")
def d18(spark, d):
    return S.top_clusters(faces(spark, d))


@query(
    "d19_noise_totals",
    "SELECT count(DISTINCT cluster_id) AS n_clusters, count(*) FILTER (cluster_id IS NULL) AS n_noise, count(cluster_id) AS n_clustered FROM {faces}",
)
def d19(spark, d):
    return S.noise_totals(faces(spark, d))


@query(
    "d20_model_consistency",
    "SELECT model_name, count(*) AS n_rows, (SELECT count(DISTINCT model_name) > 1 FROM {faces}) AS mixed FROM {faces} GROUP BY 1",
)
def d20(spark, d):
    return S.model_consistency(faces(spark, d))


@query("d21_latest_scan", "SELECT max(mtime) AS latest_scan FROM {media}")
def d21(spark, d):
    return S.latest_scan(media(spark, d).withColumnRenamed("mtime", "last_scanned_at"))


@query(
    "d22_health",
    """SELECT 'media' AS entity, count(*) AS n_rows FROM {media} UNION ALL SELECT 'faces', count(*) FROM {faces}
       UNION ALL SELECT 'clusters', count(*) FROM {clusters} UNION ALL SELECT 'media_with_pets', count(DISTINCT media_id) FROM {faces} WHERE is_pet""",
)
def d22(spark, d):
    f = faces(spark, d)
    return S.health(
        {
            "media": media(spark, d),
            "faces": f,
            "clusters": clusters(spark, d),
            "media_with_pets": f.where("is_pet").select("media_id").distinct(),
        }
    )


@query(
    "d23_suggestion_counts",
    """SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'accepted') AS accepted,
         count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status <> 'skipped') AS total FROM {suggestions}""",
)
def d23(spark, d):
    return S.suggestion_counts(suggestions(spark, d))


@query(
    "d24_concentration",
    """WITH r AS (SELECT cluster_id, count(*) AS n_hits FROM {faces} WHERE cluster_id IS NOT NULL AND is_pet GROUP BY 1)
       SELECT r.cluster_id, n_hits, round(n_hits / (SELECT sum(n_hits) FROM r), 6) AS share, s.size - n_hits AS n_others
       FROM r JOIN (""" + SIZES + """) s ON s.cluster_id = r.cluster_id ORDER BY n_hits DESC, r.cluster_id LIMIT 10""",
)
def d24(spark, d):
    f = faces(spark, d)
    out = S.concentration(f, f.where("is_pet"))
    return out.withColumn("share", F.round("share", 6))


LABELLED = "SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END || CASE WHEN toxic = 1 THEN '_toxic' ELSE '' END AS label FROM labels JOIN documents USING (doc_id)"


def labelled(spark, d):
    name = F.concat(
        F.when(F.col("quality") == 1, "good").otherwise("bad"),
        F.when(F.col("toxic") == 1, "_toxic").otherwise(""),
    )
    docs = table(spark, d, "documents").select("doc_id")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", name.alias("label"))


@query(
    "d26_class_counts",
    f"""SELECT label, count(*) AS n_images, count(*) < 10 AS too_few,
          CASE WHEN count(*) < 100 THEN 'below_100' WHEN count(*) < 200 THEN '100_to_200' ELSE 'from_200' END AS band FROM ({LABELLED}) GROUP BY 1""",
)
def d26(spark, d):
    return S.class_counts(labelled(spark, d))


@query(
    "d26_class_check",
    f"SELECT count(DISTINCT label) AS n_classes, count(*) AS n_images, count(DISTINCT label) >= 2 AND count(*) >= 30 AS usable FROM ({LABELLED})",
)
def d26_check(spark, d):
    return S.class_check(S.class_counts(labelled(spark, d)))


@query(
    "d28_media_counts",
    """SELECT m.media_id, coalesce(f.n, 0)::BIGINT AS face_count, coalesce(p.n, 0)::BIGINT AS pet_count FROM {media} m
       LEFT JOIN (SELECT media_id, count(*) AS n FROM {faces} WHERE NOT is_pet GROUP BY 1) f ON f.media_id = m.media_id
       LEFT JOIN (SELECT media_id, count(*) AS n FROM {faces} WHERE is_pet GROUP BY 1) p ON p.media_id = m.media_id""",
)
def d28(spark, d):
    f = faces(spark, d)
    return S.media_counts(media(spark, d), f.where("not is_pet"), f.where("is_pet"))


@query(
    "d29_pass_report",
    """SELECT count(*) FILTER (cluster_id IS NULL) AS noise_before, count(*) FILTER (cluster_id IS NULL AND embedding[9] > 0) AS assigned,
         count(*) FILTER (cluster_id IS NULL AND NOT embedding[9] > 0) AS remaining,
         round(count(*) FILTER (cluster_id IS NULL AND embedding[9] > 0) * 100.0::DOUBLE / count(*) FILTER (cluster_id IS NULL), 2) AS percent FROM {faces}""",
)
def d29(spark, d):
    f = faces(spark, d)
    given = F.when(F.get("embedding", 8) > 0, F.col("label"))
    return S.pass_report(f, f.withColumn("cluster_id", F.coalesce("cluster_id", given)))


@query(
    "d29_merge_report",
    "SELECT count(*) AS merges, count(DISTINCT c_nationkey) AS merge_groups FROM customer",
)
def d29_merges(spark, d):
    mapping = table(spark, d, "customer").select(
        F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("target")
    )
    return S.merge_report(mapping)


# ---- sampling, splits, triplets ----------------------------------------------------------

HASH = "('0x' || substr(md5(%s), 1, 15))::BIGINT"


@query(
    "f7_random_sample",
    "SELECT event_id FROM events ORDER BY " + HASH % "'42:' || event_id" + ", event_id LIMIT 500",
)
def f7(spark, d):
    return I.random_sample(table(spark, d, "events"), "event_id", 500).select("event_id")


@query(
    "f8_split",
    "SELECT doc_id, CASE WHEN " + HASH % "'42:' || doc_id" + " % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM labels",
)
def f8(spark, d):
    return I.split(table(spark, d, "labels"), "doc_id").select("doc_id", "part")


@query(
    "c22_triplets",
    """WITH r AS (SELECT id, label, row_number() OVER (ORDER BY label, id) - 1 AS pos FROM {faces}),
         g AS (SELECT label, min(pos) AS f, count(*) AS n FROM r GROUP BY label),
         t AS (SELECT r.id, r.pos, g.f, g.n, (SELECT count(*) FROM r) AS al, k.draw FROM r JOIN g USING (label), (SELECT unnest(range(0, 10)) AS draw) k),
         p AS (SELECT id AS anchor, draw, f + (pos - f + """ + HASH % "'42:' || id || ':' || draw || ':p'"
    + """ % (n - 1) + 1) % n AS pp, """ + HASH % "'42:' || id || ':' || draw || ':n'" + """ % (al - n) AS o, f, n FROM t WHERE n > 1)
       SELECT anchor, draw::INT AS draw, a.id AS positive, b.id AS negative FROM p JOIN r a ON a.pos = pp
       JOIN r b ON b.pos = CASE WHEN o < f THEN o ELSE o + n END""",
)
def c22(spark, d):
    return I.mine_triplets(faces(spark, d))


@query(
    "c20_changed_files",
    """SELECT path, CASE WHEN lang = 'de' THEN 'new' WHEN lang = 'fr' THEN 'never_scanned' ELSE 'modified' END AS reason
       FROM {media} WHERE lang IN ('de', 'fr') OR resolution > 12""",
)
def c20(spark, d):
    m = media(spark, d)
    one = F.expr("INTERVAL 1 SECOND")
    # A drift of exactly one second is no change, half a second more is.
    drift = F.when(F.col("resolution") > 12, F.expr("INTERVAL 1.5 SECOND")).otherwise(one)
    listing = m.select("path", (F.col("mtime") + drift).alias("modificationTime"))
    scanned = F.when(F.col("lang") != "fr", F.col("mtime"))
    known = m.where(F.col("lang") != "de").select("path", scanned.alias("last_scanned_at"))
    return I.changed(listing, known).select("path", "reason")


@query(
    "c21_upsert_children",
    """SELECT media_id, id, 'old' AS origin FROM {faces} WHERE media_id NOT IN (SELECT media_id FROM {media} WHERE lang = 'fr')
       UNION ALL SELECT media_id, media_id * 10 AS id, 'new' AS origin FROM {media} WHERE lang = 'fr'""",
)
def c21(spark, d):
    again = media(spark, d).where(F.col("lang") == "fr").select("media_id")
    new = again.select("media_id", (F.col("media_id") * 10).alias("id"), F.lit("new").alias("origin"))
    old = faces(spark, d).select("media_id", "id", F.lit("old").alias("origin"))
    return I.replace_children(old, again, new)


@query(
    "c21_upsert_media",
    "SELECT path, CASE WHEN lang = 'fr' THEN 0 ELSE size_bytes END AS size_bytes FROM {media}",
)
def c21_media(spark, d):
    m = media(spark, d)
    new = m.where(F.col("lang") == "fr").select("path", F.lit(0).cast("long").alias("size_bytes"))
    return I.upsert(m.select("path", "size_bytes"), new)


@query(
    "embed_hook",
    """SELECT id, CASE WHEN id % 97 <> 0 THEN round(embedding[1], 5) END AS head,
         CASE WHEN id % 97 = 0 THEN 'unreadable file' ELSE '' END AS error FROM {faces}""",
)
def embed(spark, d):
    """A user model run over batches; it returns the vector it is given and fails on some rows."""

    def model(batch):
        if (batch["id"] % 97 == 0).any():
            raise ValueError("unreadable file")
        return list(batch["embedding"])

    out = I.embed(faces(spark, d).select("id", "embedding"), model)
    return out.select(
        "id",
        F.round(F.get("embedding", 0).cast("double"), 5).alias("head"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "g2_label_union",
    "SELECT DISTINCT label FROM (SELECT label FROM {faces} UNION ALL SELECT id FROM {clusters})",
)
def g2(spark, d):
    ids = clusters(spark, d).select(F.col("id").alias("label"))
    return faces(spark, d).select("label").unionByName(ids).distinct()


@query(
    "g4_clusters_without_members",
    "SELECT id FROM {clusters} WHERE id NOT IN (SELECT cluster_id FROM {faces} WHERE cluster_id IS NOT NULL)",
)
def g4(spark, d):
    used = faces(spark, d).where("cluster_id is not null").select(F.col("cluster_id").alias("id"))
    return clusters(spark, d).join(used.distinct(), "id", "left_anti").select("id")


@query(
    "h24_h25_names_and_bands",
    """SELECT id, coalesce(CASE WHEN label < 5 THEN 'name' || label END, 'Person ' || label) AS name,
         CASE WHEN s > 0.85 THEN 'high_confidence' WHEN s >= 0.75 THEN 'moderate' WHEN s >= 0.65 THEN 'low' ELSE 'none' END AS band
       FROM (SELECT id, label, least(1.0, confidence * 2) AS s FROM {faces})""",
)
def h24(spark, d):
    name = F.when(F.col("label") < 5, F.concat(F.lit("name"), "label"))
    s = F.least(F.lit(1.0), F.col("confidence") * 2)
    return faces(spark, d).select(
        "id", M.display_name(name, F.col("label")).alias("name"), M.confidence_band(s).alias("band")
    )


@query(
    "k5_progress",
    "SELECT count(*) AS processed FROM {timeline}",
)
def k5(spark, d):
    """Progress of a batch pass, reported by an observation instead of a second scan."""
    from pyspark.sql import Observation

    seen = Observation("scan")
    rows = timeline(spark, d).observe(seen, F.count(F.lit(1)).alias("processed"))
    rows.groupBy("owner").agg(F.max("ts")).write.format("noop").mode("overwrite").save()
    return spark.range(1).select(F.lit(seen.get["processed"]).cast("long").alias("processed"))
