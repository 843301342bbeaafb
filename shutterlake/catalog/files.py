"""Queries over file tables: listings, duplicates, reconciliation, naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.catalog.core import hashes, manifest, media, query, table, tree
from shutterlake.functions import media as M
from shutterlake.functions import paths as P
from shutterlake.operators import dedup as D
from shutterlake.operators import review as R
from shutterlake.operators import stats as S
from shutterlake.plans.library_run import organize
from shutterlake.session import scratch_path
from shutterlake.sources import listing as L
from shutterlake.sources import reports as O
from shutterlake.sources import sessions as SE

ALL = "list_value('.jpg','.jpeg','.png','.heic','.heif','.raw','.cr2','.nef','.tiff','.tif','.bmp','.gif','.webp','.jfif')"
VID = (
    "list_value('.mp4','.mov','.avi','.mkv','.wmv','.flv','.webm','.m4v','.mpg','.mpeg','.3gp',"
    "'.3g2','.mts','.m2ts','.vob','.ogv','.ts','.divx','.xvid','.f4v','.asf','.rm','.rmvb')"
)
SUFFIX = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"
INDEXED = "list_value('.jpg','.jpeg','.png','.bmp','.gif','.tiff','.tif','.webp','.heic','.heif')"


def listing(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).select(
        "path", F.col("size_bytes").alias("length"), F.col("mtime").alias("modificationTime")
    )


def plan(spark: SparkSession, d: str) -> DataFrame:
    return D.keep_best(media(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.as_pairs(plan(spark, d))


def checked(spark: SparkSession, d: str) -> DataFrame:
    return D.pair_existence(pairs(spark, d), manifest(spark, d))


def organized(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).where(F.startswith("source", F.lit("src1")))


def originals(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).where(~F.startswith("source", F.lit("src1")))


def scratch(spark: SparkSession) -> str:
    return scratch_path(spark, "out")


# ---- flagship -------------------------------------------------------------------


@query(
    "wasted_space_by_library",
    """SELECT source, count(*) AS n_removable, sum(size_bytes)::BIGINT AS wasted_bytes
       FROM {plan} GROUP BY source""",
)
def wasted_space(spark, d):
    """Which copies can go and how much space they waste, per library."""
    removable = plan(spark, d).withColumn("source", F.split("duplicate", "/")[2])
    return D.wasted_per(removable, "source")


# ---- listings --------------------------------------------------------------------


@query(
    "a1_media_scan",
    f"""SELECT path, size_bytes AS length FROM {{media}}
        WHERE (list_contains({ALL}, {SUFFIX}) OR list_contains({VID}, {SUFFIX}))
          AND NOT starts_with(path, '/library/src3/')""",
)
def a1(spark, d):
    return L.select_media(listing(spark, d), skip_prefixes=["/library/src3"]).select("path", "length")


@query("a2_index_scan", f"SELECT path, size_bytes AS length FROM {{media}} WHERE list_contains({INDEXED}, {SUFFIX})")
def a2(spark, d):
    return L.select_media(listing(spark, d), L.INDEX_EXTENSIONS).select("path", "length")


@query(
    "a3_image_scan_capped",
    f"SELECT path FROM {{media}} WHERE list_contains({INDEXED}, {SUFFIX}) ORDER BY path LIMIT 100",
)
def a3(spark, d):
    return L.capped_images(listing(spark, d), 100).select("path")


@query(
    "a4_scan_without_folders",
    """SELECT path FROM {media} WHERE NOT list_has_any(string_split(path, '/'), ['es', 'src5'])""",
)
def a4(spark, d):
    files = L.select_media(listing(spark, d), extensions=None, excluded_parts=["es", "src5"])
    return files.select("path")


@query(
    "a5_unknown_folders",
    """SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM {media}
       WHERE lower(regexp_replace(path, '/[^/]*$', '')) LIKE '%/%unknown%'""",
)
def a5(spark, d):
    return L.unknown_folders(listing(spark, d))


@query(
    "a6_month_folders",
    """SELECT DISTINCT split_part(path, '/', 3) AS year, split_part(path, '/', 4) AS month
       FROM {tree} WHERE split_part(path, '/', 5) = 'Unknown'""",
)
def a6(spark, d):
    return L.month_folders(tree(spark, d), "/organized")


@query(
    "a7_empty_unknown_folders",
    """WITH dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM {tree}),
         kids AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS n
                  FROM {tree} WHERE size_bytes > 600 GROUP BY 1)
       SELECT dirs.path, coalesce(n, 0)::BIGINT AS children, n IS NULL AS is_empty
       FROM dirs LEFT JOIN kids ON kids.path = dirs.path WHERE dirs.path LIKE '%/Unknown'""",
)
def a7(spark, d):
    t = tree(spark, d)
    dirs = t.select(P.parent_dir(F.col("path")).alias("path")).distinct()
    return L.empty_folders(dirs, t.where(F.col("size_bytes") > 600))


@query(
    "a8_a9_pairs_csv",
    """SELECT original, duplicate FROM {pairs} WHERE original NOT LIKE '%/es/%'""",
)
def a8_a9(spark, d):
    """Write the pair list as CSV, with padding and blank cells, and read it back clean."""
    raw = pairs(spark, d).select(
        F.when(F.col("original").contains("/es/"), F.lit("  ")).otherwise(
            F.concat(F.lit(" "), "original", F.lit(" "))
        ).alias("original"),
        "duplicate",
    )
    out = scratch(spark)
    O.write_pairs(raw, f"{out}/report", f"{out}/viewer")
    return O.read_pairs(spark, f"{out}/viewer")


@query("a18_plan_audit", "SELECT sha256, keep, duplicate, keep_score, delete_score FROM {plan}")
def a18(spark, d):
    out = scratch(spark)
    O.write_plan(plan(spark, d), out)
    return spark.read.parquet(out).select("sha256", "keep", "duplicate", "keep_score", "delete_score")


@query(
    "a15_labelled_folders",
    f"""SELECT path, split_part(path, '/', -2) AS label FROM {{media}}
        WHERE list_contains(['.jpg', '.jpeg', '.png'], {SUFFIX})""",
)
def a15(spark, d):
    return L.labelled(listing(spark, d)).select("path", "label")


@query(
    "a17_review_decisions",
    """WITH c AS (SELECT p.original, p.duplicate,
          CASE WHEN m.lang = 'en' THEN 'original' WHEN m.lang = 'de' THEN 'duplicate' END AS keep,
          m.mtime AS reviewed_at
        FROM {pairs} p JOIN {media} m ON m.path = p.duplicate),
       r AS (SELECT *, coalesce(keep <> 'duplicate', true) AS ko, coalesce(keep <> 'original', true) AS kd FROM c)
       SELECT original, duplicate, ko AS "keepOriginal", kd AS "keepDuplicate",
         (SELECT max(reviewed_at) FROM r) AS "timestamp", (SELECT count(*) FROM r) AS "totalSets",
         (SELECT count(*) FROM r WHERE NOT ko OR NOT kd) AS reviewed
       FROM r""",
)
def a17(spark, d):
    kept = choices(spark, d)
    decided = R.pair_decisions(kept).join(
        kept.select("original", "duplicate", "reviewed_at"), ["original", "duplicate"]
    )
    out = scratch(spark)
    O.write_report(O.review_decisions(decided), out)
    ddl = (
        "original STRING, duplicate STRING, keepOriginal BOOLEAN, keepDuplicate BOOLEAN, "
        "timestamp TIMESTAMP_NTZ, totalSets BIGINT, reviewed BIGINT"
    )
    return O.read_report(spark, out, ddl)


@query(
    "a17_session_document",
    """WITH c AS (SELECT p.original, p.duplicate,
          CASE WHEN m.lang = 'en' THEN 'original' WHEN m.lang = 'de' THEN 'duplicate' END AS keep
        FROM {pairs} p JOIN {media} m ON m.path = p.duplicate),
       r AS (SELECT *, coalesce(keep <> 'duplicate', true) AS ko, coalesce(keep <> 'original', true) AS kd FROM c)
       SELECT row_number() OVER (ORDER BY original, duplicate) - 1 AS place, original, duplicate,
         ko AS "keepOriginal", kd AS "keepDuplicate", count(*) OVER () AS "totalSets",
         count_if(NOT ko OR NOT kd) OVER () AS reviewed
       FROM r""",
)
def a17_session(spark, d):
    """The whole review as one document, read back with the place of each decision in its list."""
    out = scratch(spark) + ".json"
    columns = ("original", "duplicate", "keepOriginal", "keepDuplicate")
    SE.write_session(R.pair_decisions(choices(spark, d)).select(*columns), out, "2024-05-01T00:00:00")
    read = SE.read_session(
        spark, out, "original: string, duplicate: string, keepOriginal: boolean, keepDuplicate: boolean"
    )
    rows = read.select("totalSets", F.col("reviewed").cast("bigint"), F.posexplode("decisions").alias("place", "x"))
    return rows.select(F.col("place").cast("bigint").alias("place"), *[f"x.{c}" for c in columns], "totalSets", "reviewed")


@query("a18_audit_log", "SELECT sha256, keep, duplicate FROM {plan}")
def a18_log(spark, d):
    """One line per pair, written in order by the audit sink and read back."""
    out = scratch(spark) + ".log"
    SE.write_audit(plan(spark, d).select("sha256", "keep", "duplicate"), out, "keep", "duplicate")
    return spark.read.schema("sha256 STRING, keep STRING, duplicate STRING").json(out)


def choices(spark: SparkSession, d: str) -> DataFrame:
    """Reviewer choices per pair, taken from the language of the duplicate."""
    m = media(spark, d).select(
        F.col("path").alias("duplicate"), "lang", F.col("mtime").alias("reviewed_at")
    )
    keep = F.when(F.col("lang") == "en", "original").when(F.col("lang") == "de", "duplicate")
    return pairs(spark, d).join(m, "duplicate").select(
        "original", "duplicate", keep.alias("keep"), "reviewed_at"
    )


# ---- predicates ------------------------------------------------------------------


@query(
    "b3_subtree_exclusion",
    "SELECT media_id, path FROM {media} WHERE NOT starts_with(path, '/library/src2/')",
)
def b3(spark, d):
    return media(spark, d).where(~P.under(F.col("path"), ["/library/src2"])).select("media_id", "path")


@query("b10_existing_pairs", """SELECT original, duplicate FROM {checked} WHERE original_exists AND duplicate_exists""")
def b10(spark, d):
    return D.existing_pairs(checked(spark, d)).select("original", "duplicate")


@query("b13_path_contains", "SELECT media_id FROM {media} WHERE lower(path) LIKE '%unknown/img\\_1%' ESCAPE '\\'")
def b13(spark, d):
    return media(spark, d).where(F.lower("path").contains("unknown/img_1")).select("media_id")


# ---- joins ----------------------------------------------------------------------


@query(
    "c1_reconcile",
    """WITH org AS (SELECT sha256, max(path) AS organized, arg_max(resolution * 1000 + size_bytes, path) AS os
          FROM {media} WHERE starts_with(source, 'src1') AND sha256 IS NOT NULL GROUP BY sha256),
        o AS (SELECT sha256, path, resolution * 1000 + size_bytes AS s FROM {media}
          WHERE NOT starts_with(source, 'src1') AND sha256 IS NOT NULL)
       SELECT sha256, CASE WHEN s > os THEN path ELSE organized END AS keep,
         CASE WHEN s > os THEN organized ELSE path END AS "delete",
         greatest(s, os) AS keep_score, least(s, os) AS delete_score,
         CASE WHEN s > os THEN 'original_higher_quality' ELSE 'organized_kept' END AS reason
       FROM o JOIN org USING (sha256)""",
)
def c1(spark, d):
    return D.reconcile(originals(spark, d), organized(spark, d))


@query(
    "c2_unique_originals",
    """SELECT media_id, path, sha256 FROM {media} WHERE NOT starts_with(source, 'src1')
         AND sha256 IS NOT NULL AND sha256 NOT IN
         (SELECT sha256 FROM {media} WHERE starts_with(source, 'src1') AND sha256 IS NOT NULL)""",
)
def c2(spark, d):
    return D.unique_originals(originals(spark, d), organized(spark, d)).select(
        "media_id", "path", "sha256"
    )


@query(
    "c3_match_duplicates",
    """SELECT m.sha256, m.path AS duplicate, o.original FROM {media} m LEFT JOIN
         (SELECT sha256, max(path) AS original FROM {media}
          WHERE starts_with(source, 'src1') AND sha256 IS NOT NULL GROUP BY sha256) o
         ON o.sha256 = m.sha256 WHERE NOT starts_with(source, 'src1')""",
)
def c3(spark, d):
    return D.match_duplicates(originals(spark, d), organized(spark, d))


@query(
    "c3_match_counts",
    """SELECT count(o.original) AS matched, count(*) - count(o.original) AS unmatched
       FROM {media} m LEFT JOIN
         (SELECT sha256, max(path) AS original FROM {media}
          WHERE starts_with(source, 'src1') AND sha256 IS NOT NULL GROUP BY sha256) o
         ON o.sha256 = m.sha256 WHERE NOT starts_with(source, 'src1')""",
)
def c3_counts(spark, d):
    return D.match_counts(D.match_duplicates(originals(spark, d), organized(spark, d)))


UNKNOWN_PLAN = """
  WITH f AS (SELECT *, regexp_replace(path, '/[^/]*/[^/]*$', '') AS month_dir,
      path LIKE '%/Unknown/%' AS inside, regexp_extract(path, '[^/]*$', 0) AS name FROM {tree}),
  s AS (SELECT DISTINCT month_dir, sha256 FROM f WHERE NOT inside AND sha256 IS NOT NULL),
  p AS (SELECT CASE WHEN s.sha256 IS NOT NULL THEN 'move_to_duplicates' ELSE 'move_to_parent' END AS action,
      f.path AS src, CASE WHEN s.sha256 IS NOT NULL THEN 'duplicates/' || name ELSE f.month_dir || '/' || name END AS dst
    FROM f LEFT JOIN s ON s.month_dir = f.month_dir AND s.sha256 = f.sha256 WHERE inside
    UNION ALL SELECT DISTINCT 'delete_folder', month_dir || '/Unknown', NULL FROM f WHERE inside)
"""


@query("c4_resolve_unknown", UNKNOWN_PLAN + "SELECT action, src, dst FROM p")
def c4(spark, d):
    return D.resolve_unknown(tree(spark, d)).select("action", "src", "dst")


@query("j10_plan_counts", UNKNOWN_PLAN + "SELECT action, count(*) AS n_items FROM p GROUP BY action")
def j10(spark, d):
    return R.plan_counts(D.resolve_unknown(tree(spark, d)))


@query(
    "c5_pair_existence",
    """SELECT original, duplicate, original_exists, duplicate_exists, coalesce(hashes_match, false) AS hashes_match,
         coalesce(original_bytes, -1)::BIGINT AS original_bytes, coalesce(duplicate_bytes, -1)::BIGINT AS duplicate_bytes
       FROM {checked}""",
)
def c5(spark, d):
    return checked(spark, d).select(
        "original",
        "duplicate",
        "original_exists",
        "duplicate_exists",
        F.coalesce("hashes_match", F.lit(False)).alias("hashes_match"),
        F.coalesce("original_bytes", F.lit(-1)).alias("original_bytes"),
        F.coalesce("duplicate_bytes", F.lit(-1)).alias("duplicate_bytes"),
    )


@query(
    "h26_verify_sample",
    """SELECT original, duplicate, CASE WHEN hashes_match THEN 'match' WHEN NOT hashes_match THEN 'differ'
         ELSE 'missing' END AS verdict FROM {checked} ORDER BY original, duplicate LIMIT 10""",
)
def h26(spark, d):
    same = F.col("hashes_match")
    verdict = F.when(same, "match").when(~same, "differ").otherwise("missing")
    return D.verify_sample(checked(spark, d)).select("original", "duplicate", verdict.alias("verdict"))


# ---- aggregates -------------------------------------------------------------------


@query(
    "d1_exact_groups",
    "SELECT sha256, count(*) AS n_files FROM {media} WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1",
)
def d1(spark, d):
    return D.exact_groups(media(spark, d))


@query(
    "d2_group_summary",
    """SELECT original, count(*) + 1 AS n_files,
         round((sum(CASE WHEN duplicate_exists THEN duplicate_bytes ELSE 0 END)
           + coalesce(max(original_bytes), 0)) / 1048576.0::DOUBLE, 2) AS size_mb,
         array_to_string(list(duplicate ORDER BY duplicate)[1:3], '|') AS first_files
       FROM {checked} GROUP BY original""",
)
def d2(spark, d):
    return D.group_summary(checked(spark, d)).withColumn("first_files", F.array_join("first_files", "|"))


@query(
    "d3_totals",
    """SELECT count(*) AS n_duplicates, count(DISTINCT original) AS n_groups, w::BIGINT AS wasted_bytes,
         round(w / 1048576.0::DOUBLE, 2) AS wasted_mb, round(w / 1073741824.0::DOUBLE, 2) AS wasted_gb
       FROM {checked}, (SELECT sum(CASE WHEN duplicate_exists THEN duplicate_bytes ELSE 0 END) AS w FROM {checked})
       GROUP BY w""",
)
def d3(spark, d):
    return D.totals(checked(spark, d))


@query(
    "d4_folder_summary",
    """WITH c AS (SELECT regexp_replace(duplicate, '/[^/]*$', '') AS folder, count(*) AS n_duplicates FROM {plan} GROUP BY 1)
       SELECT folder, n_duplicates, greatest((SELECT count(*) FROM c) - 10, 0)::BIGINT AS more_folders
       FROM c ORDER BY n_duplicates DESC, folder LIMIT 10""",
)
def d4(spark, d):
    return D.folder_summary(plan(spark, d))


@query(
    "d5_dedup_summary",
    """SELECT count(*) FILTER (n > 1) AS duplicate_sets, sum(n - 1)::BIGINT AS removable,
         count(*) AS unique_files, round(sum(n - 1) * 100.0::DOUBLE / sum(n), 2) AS percent
       FROM (SELECT count(*) AS n FROM {media} WHERE sha256 IS NOT NULL GROUP BY sha256)""",
)
def d5(spark, d):
    return D.dedup_summary(media(spark, d))


@query(
    "d6_file_totals",
    """SELECT count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes,
         round(sum(size_bytes) / 1048576.0::DOUBLE, 2) AS mb, round(sum(size_bytes) / 1073741824.0::DOUBLE, 2) AS gb
       FROM {media}""",
)
def d6(spark, d):
    return D.file_totals(media(spark, d))


SAMPLE = """
  WITH s AS (SELECT phash, md5('42:' || media_id) AS o FROM {signature} ORDER BY o LIMIT 500),
  n AS (SELECT phash, row_number() OVER (ORDER BY o) AS i FROM s),
  dist AS (SELECT bit_count(xor(a.phash, b.phash))::INT AS d FROM n a JOIN n b ON a.i < b.i),
  r AS (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM dist)
"""


def distance_counts(spark: SparkSession, d: str) -> DataFrame:
    order = F.md5(F.concat(F.lit("42:"), F.col("media_id").cast("string")))
    return D.hash_distance_counts(hashes(spark, d), order)


@query(
    "c17_d7_hash_distance_stats",
    SAMPLE
    + """, p AS (SELECT max(n) AS "count", min(d) AS "min", max(d) AS "max",
           floor(median(d))::INT AS "median",
           max(d) FILTER (rn = greatest(1, floor(0.10 * n))) AS p10,
           max(d) FILTER (rn = greatest(1, floor(0.25 * n))) AS p25,
           max(d) FILTER (rn = greatest(1, floor(0.75 * n))) AS p75,
           max(d) FILTER (rn = greatest(1, floor(0.90 * n))) AS p90 FROM r)
       SELECT *, greatest(4, least(p25 - 2, "median" - 4))::INT AS recommended_threshold FROM p""",
)
def d7(spark, d):
    return D.hash_distance_stats(distance_counts(spark, d))


@query(
    "d8_hash_distance_histogram",
    SAMPLE
    + """SELECT (d // 2 * 2) || '-' || (d // 2 * 2 + 1) AS bucket, count(*) AS n_pairs FROM dist GROUP BY 1""",
)
def d8(spark, d):
    return D.hash_distance_histogram(distance_counts(spark, d))


@query("h4_average_hash", "SELECT media_id, phash FROM {signature}")
def h4(spark, d):
    return hashes(spark, d)


ISSUES = """
  SELECT path, resolution, sha256, CASE WHEN size_bytes > 300 THEN 1 END AS phash FROM {media}"""


def warned(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d)
    phash = F.when(F.col("size_bytes") > 300, 1)
    return m.select(
        "path", M.extraction_warnings(F.col("resolution"), phash, F.col("sha256")).alias("message")
    )


@query(
    "h21_extraction_warnings",
    """SELECT path, concat_ws(', ', CASE WHEN phash IS NULL THEN 'Perceptual hash not generated' END,
         CASE WHEN sha256 IS NULL THEN 'SHA-256 hash not generated' END) AS message
       FROM (""" + ISSUES + ") WHERE phash IS NULL OR sha256 IS NULL",
)
def h21(spark, d):
    return warned(spark, d).where(F.col("message").isNotNull())


@query(
    "d9_issue_counts",
    """SELECT CASE WHEN phash IS NULL OR sha256 IS NULL THEN 'metadata_warning' ELSE 'none' END AS type,
         count(*) AS n_issues FROM (""" + ISSUES + ") GROUP BY 1",
)
def d9(spark, d):
    kind = F.when(F.col("message").isNotNull(), "metadata_warning").otherwise("none")
    return S.issue_counts(warned(spark, d).withColumn("type", kind))


@query(
    "d10_kind_counts",
    f"""SELECT count(*) FILTER (list_contains({ALL}, {SUFFIX})) AS n_images,
          count(*) FILTER (list_contains({VID}, {SUFFIX})) AS n_videos FROM {{media}}""",
)
def d10(spark, d):
    return S.kind_counts(media(spark, d))


@query(
    "d30_existence_counts",
    """WITH c AS (SELECT CASE WHEN original_exists AND duplicate_exists THEN 'both' WHEN original_exists THEN 'only_original'
           WHEN duplicate_exists THEN 'only_duplicate' ELSE 'neither' END AS category, count(*) AS n_pairs FROM {checked} GROUP BY 1)
       SELECT category, n_pairs, round(n_pairs * 100.0::DOUBLE / (SELECT sum(n_pairs) FROM c), 2) AS percent FROM c""",
)
def d30(spark, d):
    return D.existence_counts(checked(spark, d))


# ---- windows, naming --------------------------------------------------------------


@query("e1_keep_best", "SELECT sha256, keep, duplicate FROM {plan}")
def e1(spark, d):
    return plan(spark, d).select("sha256", "keep", "duplicate")


@query(
    "e2_keep_best_by_score",
    """SELECT sha256, keep, path AS duplicate, keep_score, delete_score FROM (
         SELECT sha256, path, first_value(path) OVER w AS keep,
           first_value(resolution * 1000 + size_bytes) OVER w AS keep_score,
           resolution * 1000 + size_bytes AS delete_score, row_number() OVER w AS rn
         FROM {media} WHERE sha256 IS NOT NULL
         WINDOW w AS (PARTITION BY sha256 ORDER BY resolution * 1000 + size_bytes DESC, path)) WHERE rn > 1""",
)
def e2(spark, d):
    best = D.keep_best(media(spark, d), order=D.highest_score())
    return best.select("sha256", "keep", "duplicate", "keep_score", "delete_score")


@query(
    "e2_keep_best_per_folder",
    """SELECT folder, sha256, keep, path AS duplicate FROM (
         SELECT *, first_value(path) OVER w AS keep, row_number() OVER w AS rn
         FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM {media} WHERE sha256 IS NOT NULL)
         WINDOW w AS (PARTITION BY folder, sha256 ORDER BY resolution * 1000 + size_bytes DESC, path)) WHERE rn > 1""",
)
def e2_folder(spark, d):
    m = media(spark, d).withColumn("folder", P.parent_dir(F.col("path")))
    best = D.keep_best(m, order=D.highest_score(), within=["folder"])
    return best.select("folder", "sha256", "keep", "duplicate")


@query(
    "e5_collision_names",
    """SELECT '/target/' || lang AS folder, name, path AS src,
         CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '(\\.[^.]+)$', '_' || n || '\\1') END AS target
       FROM (SELECT *, CASE WHEN m % 4 = 0 AND rn > 1 THEN rn + 1 WHEN m % 2 = 0 THEN rn ELSE rn - 1 END AS n FROM (
         SELECT *, row_number() OVER (PARTITION BY lang, name ORDER BY path) AS rn,
           min(media_id) OVER (PARTITION BY lang, name) AS m FROM {media}))""",
)
def e5(spark, d):
    """Half of the names exist in their folder, half of those with the suffix 2 as well."""
    m = media(spark, d)
    folder = F.concat(F.lit("/target/"), "lang").alias("folder")
    names = m.groupBy(folder, "name").agg(F.min("media_id").alias("m"))
    have = (
        names.where(F.col("m") % 2 == 0)
        .select("folder", "name")
        .unionByName(
            names.where(F.col("m") % 4 == 0).select(
                "folder", P.suffixed_name(F.col("name"), F.lit(2), "plain").alias("name")
            )
        )
    )
    return D.number_collisions(m.select(folder, "name", F.col("path").alias("src")), have)


@query(
    "h16_h17_target_folder",
    """SELECT path AS src, CASE WHEN ts IS NULL THEN
         'Organized/Unknown_Metadata/1-Small_Under1MB/' || strftime(mtime, '%Y/%m-%B')
         ELSE 'Organized/' || strftime(ts, '%Y/%m-%B') END
         || CASE WHEN place = '' THEN '' ELSE '/' || place END AS folder
       FROM (SELECT *, trim(regexp_replace(trim(split_part(coalesce(p, ''), ',', 1)), '[^a-zA-Z0-9 _-]', '', 'g')) AS place
             FROM (SELECT *, CASE WHEN lang = 'es' THEN ' Rua #' || (media_id % 7) || ' (x), Town' END AS p FROM {media}))""",
)
def h17(spark, d):
    address = F.when(
        F.col("lang") == "es",
        F.concat(F.lit(" Rua #"), F.col("media_id") % 7, F.lit(" (x), Town")),
    )
    return organize(media(spark, d).withColumn("location_name", address)).select("src", "folder")


@query(
    "h18_h20_sizes",
    f"""SELECT media_id,
          CASE WHEN b / 1048576.0 < 1 THEN '1-Small_Under1MB' WHEN b / 1048576.0 < 5 THEN '2-Medium_1-5MB'
            WHEN b / 1048576.0 < 15 THEN '3-Large_5-15MB' ELSE '4-XL_Over15MB' END AS bucket,
          round(b / 1048576.0::DOUBLE, 2) AS mb, round(px / 1e6, 2) AS megapixels,
          resolution || 'x' || resolution * 2 AS text,
          CASE WHEN v THEN b ELSE px END AS proxy,
          CASE WHEN v THEN trunc(b / 1048576.0::DOUBLE * 1000000)::BIGINT ELSE px END AS viewer
        FROM (SELECT *, size_bytes * 5000 AS b, resolution * resolution * 20000 AS px,
                list_contains({VID}, {SUFFIX}) AS v FROM {{media}})""",
)
def h18(spark, d):
    b, px = F.col("size_bytes") * 5000, F.col("resolution") * F.col("resolution") * 20000
    v = P.is_video(F.col("path"))
    return media(spark, d).select(
        "media_id",
        P.size_bucket(b).alias("bucket"),
        M.size_mb(b).alias("mb"),
        M.megapixels(px).alias("megapixels"),
        M.resolution_text(F.col("resolution"), F.col("resolution") * 2).alias("text"),
        M.resolution_or_proxy(px, b, v).alias("proxy"),
        M.viewer_resolution(px, b, v).alias("viewer"),
    )


@query(
    "h1_h2_hash_and_score",
    "SELECT media_id, sha256(text) AS sha256, resolution * 1000 + size_bytes AS score FROM {media}",
)
def h1(spark, d):
    return media(spark, d).select(
        "media_id",
        M.content_hash(F.col("text")).alias("sha256"),
        M.quality_score(F.col("resolution"), F.col("size_bytes")).alias("score"),
    )


PAGE_PATHS = """
  SELECT page_id, regexp_replace(url, '^[a-z]+://', '/mnt/') || CASE page_id % 5
    WHEN 0 THEN '/IMG-DESKTOP-' || page_id || '.jpg' WHEN 1 THEN '/IMG (conflicted copy).jpg'
    WHEN 2 THEN '/IMG (' || page_id || ').jpg' WHEN 3 THEN '/OneDrive/IMG-' || page_id || '.jpg'
    ELSE '/Dropbox/IMG.jpg' END AS path FROM pages"""


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    base = F.regexp_replace("url", "^[a-z]+://", "/mnt/")
    tail = (
        F.when(n % 5 == 0, F.concat(F.lit("/IMG-DESKTOP-"), n, F.lit(".jpg")))
        .when(n % 5 == 1, F.lit("/IMG (conflicted copy).jpg"))
        .when(n % 5 == 2, F.concat(F.lit("/IMG ("), n, F.lit(").jpg")))
        .when(n % 5 == 3, F.concat(F.lit("/OneDrive/IMG-"), n, F.lit(".jpg")))
        .otherwise(F.lit("/Dropbox/IMG.jpg"))
    )
    return table(spark, d, "pages").select(n, F.concat(base, tail).alias("path"))


@query(
    "h14_h15_sync_names",
    "SELECT page_id, page_id % 5 <= 2 AS conflict, CASE page_id % 5 WHEN 3 THEN 'onedrive' WHEN 4 THEN 'dropbox' END AS provider FROM ("
    + PAGE_PATHS + ")",
)
def h14(spark, d):
    return page_paths(spark, d).select(
        "page_id",
        P.is_sync_conflict(F.col("path")).alias("conflict"),
        P.sync_provider(F.col("path")).alias("provider"),
    )


@query(
    "d32_sync_report",
    """SELECT true AS is_cloud_synced, 'onedrive' AS provider, count(*) FILTER (page_id % 5 <= 2) AS total_conflicts,
         'exclude generated folders from sync | review conflict copies' AS recommendations FROM pages""",
)
def d32(spark, d):
    return S.sync_report(page_paths(spark, d), "/home/me/OneDrive/Photos")


@query(
    "d32_sync_conflicts", "SELECT path FROM (" + PAGE_PATHS + ") WHERE page_id % 5 <= 2"
)
def d32_list(spark, d):
    return S.sync_conflicts(page_paths(spark, d))


@query(
    "f2_pair_page",
    """SELECT original, duplicate, 'set-' || (9 + row_number() OVER (ORDER BY original, duplicate)) AS set_id
       FROM (SELECT * FROM {pairs} ORDER BY original, duplicate LIMIT 25 OFFSET 10)""",
)
def f2(spark, d):
    return R.pair_page(pairs(spark, d), limit=25, offset=10)


@query(
    "f2_page_info",
    "SELECT count(*) AS total, greatest(0, least(25, count(*) - 10))::BIGINT AS n_rows, 10 + greatest(0, least(25, count(*) - 10)) < count(*) AS has_more FROM {pairs}",
)
def f2_info(spark, d):
    return R.page_info(pairs(spark, d), limit=25, offset=10)


@query(
    "f4_time_order",
    """SELECT media_id, row_number() OVER (ORDER BY ts NULLS LAST, media_id) AS position FROM {media}""",
)
def f4(spark, d):
    from shutterlake.operators.ordering import number_rows

    rows = media(spark, d).select("media_id", "ts")
    order = [F.col("ts").asc_nulls_last(), F.col("media_id").asc()]
    return number_rows(rows, [], order, "position").select("media_id", "position")


@query(
    "f6_group_by_mtime",
    """SELECT c.original, c.duplicate, m.mtime FROM {pairs} c JOIN {media} m ON m.path = c.duplicate
       WHERE c.original = (SELECT min(original) FROM {pairs})""",
)
def f6(spark, d):
    p = pairs(spark, d)
    first = p.agg(F.min("original")).scalar()
    times = media(spark, d).select(F.col("path").alias("duplicate"), "mtime")
    return (
        p.where(F.col("original") == first)
        .join(times, "duplicate")
        .orderBy("mtime", "duplicate")
        .select("original", "duplicate", "mtime")
    )


@query(
    "g1_plan_union",
    """SELECT 'exact' AS reason, duplicate FROM {plan} UNION ALL
       SELECT 'undated', path FROM {media} WHERE ts IS NULL""",
)
def g1(spark, d):
    undated = media(spark, d).where(F.col("ts").isNull())
    return (
        plan(spark, d)
        .select(F.lit("exact").alias("reason"), "duplicate")
        .unionByName(undated.select(F.lit("undated").alias("reason"), F.col("path").alias("duplicate")))
    )


@query(
    "g3_media_extensions",
    f"""SELECT {SUFFIX} AS extension, count(*) AS n_files FROM {{media}}
        WHERE list_contains(list_concat({ALL}, {VID}), {SUFFIX}) GROUP BY 1""",
)
def g3(spark, d):
    ext = P.extension(F.col("path"))
    return (
        media(spark, d)
        .where(ext.isin(*P.IMAGE_EXTENSIONS, *P.VIDEO_EXTENSIONS))
        .groupBy(ext.alias("extension"))
        .agg(F.count("*").alias("n_files"))
    )


@query(
    "j8_pair_decisions",
    """SELECT p.original, p.duplicate, m.lang IS DISTINCT FROM 'de' AS "keepOriginal",
         m.lang IS DISTINCT FROM 'en' AS "keepDuplicate",
         CASE WHEN m.lang IN ('en', 'de') THEN 'reviewed' ELSE 'undecided' END AS state
       FROM {pairs} p JOIN {media} m ON m.path = p.duplicate""",
)
def j8(spark, d):
    return R.pair_decisions(choices(spark, d))


@query(
    "j8_decision_summary",
    """SELECT count(*) AS total, count(*) FILTER (m.lang IN ('en', 'de')) AS reviewed,
         count(*) FILTER (m.lang NOT IN ('en', 'de')) AS undecided, count(*) FILTER (m.lang IN ('en', 'de')) AS to_delete
       FROM {pairs} p JOIN {media} m ON m.path = p.duplicate""",
)
def j8_summary(spark, d):
    return R.decision_summary(R.pair_decisions(choices(spark, d)))


@query(
    "b11_j9_removal_plan",
    """SELECT p.path, CASE WHEN NOT a THEN 'error' WHEN m.path IS NOT NULL THEN 'delete' ELSE 'error' END AS action,
         CASE WHEN NOT a THEN 'path not allowed' WHEN m.path IS NULL THEN 'file not found' END AS reason
       FROM (SELECT path, starts_with(path, '/library/src1/') OR starts_with(path, '/library/src2/') AS a
             FROM (SELECT original AS path FROM {pairs} UNION SELECT duplicate FROM {pairs})) p
       LEFT JOIN {manifest} m ON m.path = p.path""",
)
def j9(spark, d):
    wanted = R.both_files(pairs(spark, d))
    return R.removal_plan(wanted, manifest(spark, d), ["/library/src1", "/library/src2"])
