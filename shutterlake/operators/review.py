"""The human review loop: suggestions, decisions, merges, removals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import media as M
from shutterlake.functions import paths as P
from shutterlake.functions import vectors as V
from shutterlake.operators import neighbors as N
from shutterlake.operators.dedup import first_per_group
from shutterlake.operators.graph import connected_components
from shutterlake.operators.ordering import exact_quantile, number_rows
from shutterlake.operators.skew import skew_join
from shutterlake.operators.vectors import centroids
from shutterlake.session import materialize

BAND = (0.20, 0.30)
OUTLIER_MIN_SIZE, OUTLIER_QUANTILE, OUTLIER_MIN_DISTANCE = 5, 0.75, 0.20
PERSON_FIELDS = ("display_name", "description", "is_hidden")


# ---- suggestions ---------------------------------------------------------------


def boundary_suggestions(
    faces: DataFrame,
    band: tuple[float, float] = BAND,
    limit: int | None = None,
    key: str = "id",
    vector: str = "embedding",
    **route,
) -> DataFrame:
    """Noise faces whose nearest clustered face lies inside the band (ends included)."""
    low, high = band
    noise = N.vector_rows(faces.where(F.col("cluster_id").isNull()), key, vector)
    known = N.vector_rows(faces.where(F.col("cluster_id").isNotNull()), key, vector, ["cluster_id"])
    near = N.knn_join(noise, known, 1, high, closed=True, carry=["cluster_id"], **route)
    out = near.where(F.col("distance") >= low).select(
        F.col("id").alias("face_id"),
        F.col("cluster_id").alias("suggested_cluster_id"),
        "distance",
        F.lit("boundary_noise").alias("reason"),
        F.lit("pending").alias("status"),
    )
    return out.orderBy("face_id").limit(limit) if limit is not None else out


def outlier_suggestions(
    faces: DataFrame,
    clusters: DataFrame,
    limit: int | None = None,
    key: str = "id",
    vector: str = "embedding",
    min_distance: float = OUTLIER_MIN_DISTANCE,
) -> DataFrame:
    """Members of visible clusters that lie far out: beyond the cluster's p75 and the minimum.

    The quantile is read off exact ranks, so a cluster of any size works.
    """
    shown = clusters.where(~F.col("is_hidden")).select(F.col("id").alias("cluster_id"))
    rows = (
        faces.where(V.usable_vector(F.col(vector)))
        .join(shown, "cluster_id", "left_semi")
        .select(F.col(key).alias("id"), "cluster_id", V.unit(F.col(vector)).alias("_u"))
    )
    cents = materialize(centroids(rows, "cluster_id", "_u", min_size=OUTLIER_MIN_SIZE))
    dist = skew_join(rows, cents, ["cluster_id"]).select(
        "id", "cluster_id", (1 - V.dot(F.col("_u"), F.col("centroid"))).alias("distance")
    )
    dist = materialize(dist)
    p75 = exact_quantile(dist, ["cluster_id"], "distance", OUTLIER_QUANTILE, "p75", "id")
    out = (
        skew_join(dist, p75, ["cluster_id"])
        .where((F.col("distance") > F.col("p75")) & (F.col("distance") > min_distance))
        .select(
            F.col("id").alias("face_id"),
            F.col("cluster_id").alias("suggested_cluster_id"),
            "distance",
            F.lit("cluster_outlier").alias("reason"),
            F.lit("pending").alias("status"),
        )
    )
    if limit is None:
        return out
    return out.orderBy("suggested_cluster_id", "face_id").limit(limit)


def new_suggestions(
    faces: DataFrame, clusters: DataFrame, max_suggestions: int | None = None, **options
) -> DataFrame:
    """Boundary cases and outliers; under a cap boundary cases come first and outliers fill the rest."""
    if max_suggestions is None:
        return boundary_suggestions(faces, **options).unionByName(outlier_suggestions(faces, clusters))
    first = boundary_suggestions(faces, limit=max_suggestions, **options)
    # At most max_suggestions rows: safe to count and rank in one place.
    room = F.lit(max_suggestions) - first.agg(F.count("*")).scalar()
    extra = outlier_suggestions(faces, clusters, limit=max_suggestions)
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(0)).orderBy("suggested_cluster_id", "face_id")
    extra = extra.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= room).drop("_n")
    return first.unionByName(extra)


def refresh_suggestions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Pending suggestions are replaced, reviewed ones stay."""
    cols = ["face_id", "suggested_cluster_id", "distance", "reason", "status"]
    kept = existing.where(F.col("status") != "pending").select(*cols)
    return kept.unionByName(new.select(*cols))


def pending_queue(
    suggestions: DataFrame,
    faces: DataFrame,
    clusters: DataFrame,
    limit: int,
    samples: int = 5,
) -> DataFrame:
    """Most distant pending suggestions with cluster name and sample faces.

    The page is cut first; rows whose face or cluster is gone then drop out.
    Only clusters on the page are sampled.
    """
    page = (
        suggestions.where(F.col("status") == "pending")
        .orderBy(F.desc("distance"), "id")
        .limit(limit)
    )
    named = clusters.select(F.col("id").alias("suggested_cluster_id"), "display_name")
    have = faces.select(F.col("id").alias("face_id"))
    rows = page.join(have, "face_id").join(named, "suggested_cluster_id")
    wanted = page.select(F.col("suggested_cluster_id").alias("cluster_id")).distinct()
    firsts = first_per_group(
        faces.select("id", "cluster_id").join(F.broadcast(wanted), "cluster_id"),
        ["cluster_id"],
        [F.col("id").asc()],
        samples,
    )
    lists = firsts.groupBy(F.col("cluster_id").alias("suggested_cluster_id")).agg(
        F.array_sort(F.collect_list("id")).alias("sample_faces")
    )
    cid = F.col("suggested_cluster_id")
    return rows.join(lists, "suggested_cluster_id", "left").select(
        "id",
        "face_id",
        "suggested_cluster_id",
        M.display_name(F.col("display_name"), cid).alias("person_name"),
        "distance",
        "reason",
        "sample_faces",
    )


# ---- listings --------------------------------------------------------------------


def cluster_listing(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters with member counts, largest first. Members are counted before the join."""
    counts = (
        members.where(F.col("cluster_id").isNotNull())
        .groupBy(F.col("cluster_id").alias("id"))
        .agg(F.count("*").alias("n_members"))
    )
    return (
        clusters.join(counts, "id", "left")
        .withColumn("n_members", F.coalesce("n_members", F.lit(0)))
        .orderBy(F.desc("n_members"), "id")
    )


def without_pet_clusters(clusters: DataFrame, faces: DataFrame, sample: int = 5) -> DataFrame:
    """Drop person clusters where one of the first faces is flagged as a pet (`is_pet`)."""
    firsts = first_per_group(
        faces.where(F.col("cluster_id").isNotNull()).select("cluster_id", "id", "is_pet"),
        ["cluster_id"],
        [F.col("id").asc()],
        sample,
    )
    bad = (
        firsts.groupBy(F.col("cluster_id").alias("id"))
        .agg(F.bool_or("is_pet").alias("_bad"))
        .where("_bad")
        .select("id")
    )
    return clusters.join(bad, "id", "left_anti")


def covers(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Cover per cluster: primary member, else first with thumbnail, else first with media."""
    firsts = (
        members.where(F.col("cluster_id").isNotNull())
        .groupBy(F.col("cluster_id").alias("id"))
        .agg(
            F.min(F.when(F.col("thumbnail_path").isNotNull(), F.col("id"))).alias("_thumb"),
            F.min(F.when(F.col("media_id").isNotNull(), F.col("id"))).alias("_media"),
        )
    )
    return clusters.join(firsts, "id", "left").select(
        "id", F.coalesce("primary_id", "_thumb", "_media").alias("cover_id")
    )


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Total, rows on the page, and whether more follow."""
    total = F.count("*")
    count = F.greatest(F.lit(0), F.least(F.lit(limit), total - offset))
    return df.agg(
        total.alias("total"),
        count.alias("n_rows"),
        (F.lit(offset) + count < total).alias("has_more"),
    )


def pair_page(pairs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Page of duplicate pairs with ids `set-<position>`; at most `limit` rows are numbered."""
    from pyspark.sql import Window as W

    rows = page(pairs, ["original", "duplicate"], limit, offset)
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("original", "duplicate"))
    return rows.withColumn("set_id", F.concat(F.lit("set-"), (n - 1 + offset).cast("string")))


def name_search(clusters: DataFrame, query: str) -> DataFrame:
    name = F.lower(F.coalesce("display_name", F.lit("unknown")))
    return clusters.where(name.contains(query.lower()))


# ---- decisions -------------------------------------------------------------------


def latest_decisions(decisions: DataFrame, by: str) -> DataFrame:
    """One decision per target row: the one reviewed last."""
    others = [c for c in decisions.columns if c != by]
    order = F.struct("reviewed_at", *[c for c in others if c != "reviewed_at"])
    return decisions.groupBy(by).agg(F.max(order).alias("_d")).select(by, "_d.*")


def decide_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status and review time from decisions (suggestion_id, action, reviewed_at)."""
    done = latest_decisions(decisions, "suggestion_id")
    status = (
        F.when(F.col("action") == "accept", "accepted")
        .when(F.col("action") == "reject", "rejected")
        .when(F.col("action") == "skip", "skipped")
    )
    d = done.select(
        F.col("suggestion_id").alias("id"),
        status.alias("_status"),
        F.col("reviewed_at").alias("_at"),
    )
    return suggestions.join(d, "id", "left").select(
        *[
            F.coalesce("_status", "status").alias("status")
            if c == "status"
            else F.coalesce("_at", "reviewed_at").alias("reviewed_at")
            if c == "reviewed_at"
            else c
            for c in suggestions.columns
        ]
    )


def accept_suggestions(
    faces: DataFrame, suggestions: DataFrame, decisions: DataFrame
) -> DataFrame:
    """Faces moved to the cluster of their latest accepted suggestion.

    An accept moves the face at once; a later skip or reject does not move it back.
    """
    accepted = decisions.where(F.col("action") == "accept")
    moves = (
        accepted.join(suggestions, F.col("suggestion_id") == suggestions["id"])
        .groupBy("face_id")
        .agg(
            F.max_by(
                "suggested_cluster_id", F.struct(accepted["reviewed_at"], "suggestion_id")
            ).alias("_to")
        )
    )
    return _move(faces, moves.withColumnRenamed("face_id", "id"))


def _move(faces: DataFrame, moves: DataFrame) -> DataFrame:
    return faces.join(moves, "id", "left").select(
        *[
            F.coalesce("_to", "cluster_id").alias("cluster_id") if c == "cluster_id" else c
            for c in faces.columns
        ]
    )


def new_cluster_ids(clusters: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, new_id): ids after the largest existing one, in key order."""
    top = clusters.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top")).withColumn(
        "_one", F.lit(1)
    )
    numbered = number_rows(wanted.select(key).distinct(), [], [F.col(key).asc()], "_n")
    return (
        numbered.withColumn("_one", F.lit(1))
        .join(F.broadcast(top), "_one")
        .select(key, (F.col("_top") + F.col("_n")).alias("new_id"))
    )


def reject_into_new_clusters(
    faces: DataFrame, clusters: DataFrame, suggestions: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(faces, new clusters): a rejection may open an unnamed cluster, but only for a noise face.

    The first such rejection of a face counts, and only if no accept came before,
    which would have moved the face. Apply accepts to the result: a later one
    moves the face on.
    """
    opens = (F.col("action") == "reject") & F.col("create_new")
    wanted = (
        decisions.join(suggestions, F.col("suggestion_id") == suggestions["id"])
        .groupBy(F.col("face_id").alias("id"))
        .agg(
            F.min(F.when(opens, decisions["reviewed_at"])).alias("_open"),
            F.min(F.when(F.col("action") == "accept", decisions["reviewed_at"])).alias("_accept"),
        )
        .where(F.col("_open").isNotNull() & (F.col("_accept").isNull() | (F.col("_open") < F.col("_accept"))))
        .select("id")
        .join(faces.where(F.col("cluster_id").isNull()), "id", "left_semi")
    )
    ids = new_cluster_ids(clusters, wanted, "id")
    moved = _move(faces, ids.select("id", F.col("new_id").alias("_to")))
    made = ids.select(
        F.col("new_id").alias("id"),
        F.lit(None).cast("string").alias("display_name"),
    )
    return moved, made


def assign_faces(
    faces: DataFrame, clusters: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(faces, errors) for requests (face_id, cluster_id, reviewed_at)."""
    asked = latest_decisions(requests, "face_id")
    known_cluster = clusters.select(F.col("id").alias("cluster_id"), F.lit(True).alias("_c"))
    known_face = faces.select(F.col("id").alias("face_id"), F.lit(True).alias("_f"))
    checked = asked.join(known_cluster, "cluster_id", "left").join(known_face, "face_id", "left")
    ok = checked.where(F.col("_c") & F.col("_f"))
    errors = checked.where(F.col("_c").isNull() | F.col("_f").isNull()).select(
        "face_id",
        "cluster_id",
        F.when(F.col("_f").isNull(), "face not found").otherwise("cluster not found").alias("error"),
    )
    moved = _move(faces, ok.select(F.col("face_id").alias("id"), F.col("cluster_id").alias("_to")))
    return moved, errors


def resolve_merges(requests: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source -> final target, errors) for requests (source, target).

    A source equal to its target, or a target that does not exist, is an error.
    Chains and several targets for one source end in one component, whose
    survivor is its smallest cluster that is not merged away, else its smallest.
    """
    ids = clusters.select("id")
    known = requests.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    known = known.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    bad = F.col("source") == F.col("target")
    valid = known.where(~bad)
    errors = requests.where(bad).select("source", "target", F.lit("target among sources").alias("error"))
    missing = requests.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").where(~bad)
    errors = errors.unionByName(
        missing.select("source", "target", F.lit("target not found").alias("error"))
    )
    comp = connected_components(
        ids, valid.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    )
    sources = valid.select(F.col("source").alias("id"), F.lit(True).alias("_is_source")).distinct()
    marked = comp.join(sources, "id", "left")
    keep = marked.groupBy("component").agg(
        F.coalesce(F.min(F.when(F.col("_is_source").isNull(), F.col("id"))), F.min("id")).alias(
            "target"
        )
    )
    mapping = (
        skew_join(comp, keep, ["component"])
        .where(F.col("id") != F.col("target"))
        .select(F.col("id").alias("source"), "target")
    )
    return mapping, errors


def merge_with_audit(
    faces: DataFrame, clusters: DataFrame, mapping: DataFrame, by: str, at: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, clusters, merge events): members move, sources go, every source is logged."""
    moved = faces.join(
        mapping.select(F.col("source").alias("cluster_id"), F.col("target").alias("_to")),
        "cluster_id",
        "left",
    ).select(
        *[
            F.coalesce("_to", "cluster_id").alias("cluster_id") if c == "cluster_id" else c
            for c in faces.columns
        ]
    )
    left = clusters.join(mapping.select(F.col("source").alias("id")), "id", "left_anti")
    events = mapping.select(
        F.col("source").alias("source_cluster_id"),
        F.col("target").alias("target_cluster_id"),
        at.alias("merged_at"),
        F.lit(by).alias("initiated_by"),
    )
    return moved, left, events


def update_fields(
    clusters: DataFrame,
    changes: DataFrame,
    allowed: Iterable[str] = PERSON_FIELDS,
    time: str | None = None,
) -> DataFrame:
    """Apply change rows (id, field columns); only allowed fields count, null leaves a field alone.

    Of several changes of one field the last by the `time` column counts, without
    one, or at the same time, the greatest value.
    """
    fields = [c for c in changes.columns if c in set(allowed)]
    when = [F.col(time)] if time else []

    def last(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(*when, F.col(c).alias("value"))))["value"]

    new = changes.groupBy("id").agg(*[last(c).alias(f"_new_{c}") for c in fields])
    return clusters.join(new, "id", "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else c for c in clusters.columns]
    )


def soft_delete(
    media: DataFrame, requests: DataFrame, root: str, trash: str, session_id: str
) -> tuple[DataFrame, DataFrame]:
    """(media, delete log): rows are flagged missing, the trash path keeps the relative path."""
    asked = requests.groupBy("media_id").agg(F.max("deleted_at").alias("deleted_at"))
    flagged = media.join(
        asked.select("media_id", F.lit(True).alias("_gone")), "media_id", "left"
    ).select(
        *[
            F.coalesce("_gone", "is_missing").alias("is_missing") if c == "is_missing" else c
            for c in media.columns
        ]
    )
    inside = P.under(F.col("path"), [root])
    relative = F.when(inside, F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path")))
    log = media.join(asked, "media_id").select(
        "media_id",
        F.col("path").alias("original_path"),
        F.concat_ws("/", F.lit(trash), F.coalesce(relative, P.file_name(F.col("path")))).alias(
            "trash_path"
        ),
        "deleted_at",
        F.lit(session_id).alias("session_id"),
    )
    return flagged, log


def pair_decisions(pairs: DataFrame) -> DataFrame:
    """From the `keep` choice (original, duplicate, both or null) to keep flags and a state."""
    keep = F.col("keep")
    return pairs.select(
        "original",
        "duplicate",
        F.coalesce(keep != "duplicate", F.lit(True)).alias("keepOriginal"),
        F.coalesce(keep != "original", F.lit(True)).alias("keepDuplicate"),
        F.when(keep.isNull(), "undecided").otherwise("reviewed").alias("state"),
    )


def decision_summary(decided: DataFrame) -> DataFrame:
    return decided.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "reviewed").alias("reviewed"),
        F.count_if(F.col("state") == "undecided").alias("undecided"),
        F.count_if(~F.col("keepOriginal") | ~F.col("keepDuplicate")).alias("to_delete"),
    )


def removal_plan(paths: DataFrame, manifest: DataFrame, roots: Iterable[str]) -> DataFrame:
    """Per requested path: delete when it exists under an allowed root, else the error."""
    have = manifest.select("path", F.lit(True).alias("_here")).distinct()
    allowed = P.under(F.col("path"), roots)
    return paths.join(have, "path", "left").select(
        "path",
        F.when(~allowed, "error").when(F.col("_here"), "delete").otherwise("error").alias("action"),
        F.when(~allowed, "path not allowed")
        .when(F.col("_here").isNull(), "file not found")
        .alias("reason"),
    )


def both_files(pairs: DataFrame) -> DataFrame:
    """Both paths of every pair as removal requests."""
    return pairs.select(F.explode(F.array("original", "duplicate")).alias("path")).distinct()


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n_items"))
