"""Reports: counts, sizes, health and consistency."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import paths as P

# Class sizes that draw a warning, a failure, and the advice bands.
MIN_CLASSES, WARN_PER_CLASS, MIN_TOTAL, BANDS = 2, 10, 30, (100, 200)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").agg(F.count("*").alias("n_issues"))


def kind_counts(media: DataFrame) -> DataFrame:
    path = F.col("path")
    return media.agg(
        F.count_if(P.has_extension(path, P.IMAGE_EXTENSIONS)).alias("n_images"),
        F.count_if(P.has_extension(path, P.VIDEO_EXTENSIONS)).alias("n_videos"),
    )


def cluster_sizes(labels: DataFrame, by: str = "cluster_id", noise: int = -1) -> DataFrame:
    """(cluster, size) without noise, whether noise is null or a number."""
    return (
        labels.where(F.col(by).isNotNull() & (F.col(by) != noise))
        .groupBy(by)
        .agg(F.count("*").alias("size"))
    )


def size_stats(labels: DataFrame, by: str = "cluster_id") -> DataFrame:
    """Clusters, members, extremes, mean and median size.

    The median comes from the size frequencies, of which there are far fewer
    than clusters.
    """
    freq = size_frequency(labels, by)
    upto = W.partitionBy(F.lit(0)).orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    cum = freq.withColumn("_to", F.sum("n_clusters").over(upto)).withColumn(
        "_n", F.sum("n_clusters").over(W.partitionBy(F.lit(0)))
    )

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_to") > index, F.col("size")))

    n = F.col("_n")
    members = F.sum(F.col("size") * F.col("n_clusters"))
    return cum.agg(
        F.sum("n_clusters").alias("n_clusters"),
        members.alias("n_members"),
        F.max("size").alias("largest"),
        F.min("size").alias("smallest"),
        (members / F.sum("n_clusters")).alias("mean_size"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median_size"),
    )


def size_frequency(labels: DataFrame, by: str = "cluster_id") -> DataFrame:
    return cluster_sizes(labels, by).groupBy("size").agg(F.count("*").alias("n_clusters"))


def top_clusters(labels: DataFrame, n: int = 10, by: str = "cluster_id") -> DataFrame:
    return cluster_sizes(labels, by).orderBy(F.desc("size"), by).limit(n)


def noise_totals(labels: DataFrame, by: str = "cluster_id", noise: int = -1) -> DataFrame:
    is_noise = F.col(by).isNull() | (F.col(by) == noise)
    return labels.agg(
        F.count_distinct(F.when(~is_noise, F.col(by))).alias("n_clusters"),
        F.count_if(is_noise).alias("n_noise"),
        F.count_if(~is_noise).alias("n_clustered"),
    )


def model_consistency(faces: DataFrame) -> DataFrame:
    """Rows per embedding model; `mixed` warns when there is more than one."""
    counts = faces.groupBy("model_name").agg(F.count("*").alias("n_rows"))
    n = counts.agg((F.count("*") > 1).alias("mixed")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").drop("_one")


def latest_scan(media: DataFrame) -> DataFrame:
    return media.agg(F.max("last_scanned_at").alias("latest_scan"))


def health(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("entity"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def suggestion_counts(suggestions: DataFrame) -> DataFrame:
    """Counts per status; the total leaves skipped ones out."""
    s = F.col("status")
    return suggestions.agg(
        F.count_if(s == "pending").alias("pending"),
        F.count_if(s == "accepted").alias("accepted"),
        F.count_if(s == "rejected").alias("rejected"),
        F.count_if(s.isin("pending", "accepted", "rejected")).alias("total"),
    )


def concentration(
    members: DataFrame, reference: DataFrame, top: int = 10, key: str = "id"
) -> DataFrame:
    """Clusters that hold most of a reference set, their share of it, and who else is in them."""
    chosen = members.join(reference.select(key), key, "left_semi").where("cluster_id is not null")
    hits = chosen.groupBy("cluster_id").agg(F.count("*").alias("n_hits"))
    total = hits.agg(F.sum("n_hits").alias("_total")).withColumn("_one", F.lit(1))
    best = hits.orderBy(F.desc("n_hits"), "cluster_id").limit(top)
    sizes = members.where("cluster_id is not null").groupBy("cluster_id").agg(
        F.count("*").alias("_size")
    )
    return (
        best.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .join(sizes, "cluster_id")
        .select(
            "cluster_id",
            "n_hits",
            (F.col("n_hits") / F.col("_total")).alias("share"),
            (F.col("_size") - F.col("n_hits")).alias("n_others"),
        )
    )


def class_counts(labelled: DataFrame) -> DataFrame:
    """Images per class with a warning flag and the advice band of its size."""
    n = F.col("n_images")
    low, high = BANDS
    return (
        labelled.groupBy("label")
        .agg(F.count("*").alias("n_images"))
        .select(
            "label",
            "n_images",
            (n < WARN_PER_CLASS).alias("too_few"),
            F.when(n < low, f"below_{low}")
            .when(n < high, f"{low}_to_{high}")
            .otherwise(f"from_{high}")
            .alias("band"),
        )
    )


def class_check(counts: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("n_images"), F.lit(0))
    return counts.agg(
        F.count("*").alias("n_classes"),
        total.alias("n_images"),
        ((F.count("*") >= MIN_CLASSES) & (total >= MIN_TOTAL)).alias("usable"),
    )


def presence(df: DataFrame, array_col: str, min_conf: float = 0.5) -> DataFrame:
    """Dog and cat counts per photo and the folder the photo is routed to."""

    def count(label: str) -> Column:
        return F.size(
            F.filter(
                F.col(array_col), lambda d: (d["label"] == label) & (d["confidence"] >= min_conf)
            )
        )

    others = [c for c in df.columns if c != array_col]
    counted = df.select(*others, count("dog").alias("dog_count"), count("cat").alias("cat_count"))
    has_dog, has_cat = F.col("dog_count") > 0, F.col("cat_count") > 0
    return counted.withColumns(
        {
            "has_dog": has_dog,
            "has_cat": has_cat,
            "route": F.when(has_dog & has_cat, "both").when(has_dog, "dogs").when(has_cat, "cats"),
        }
    )


def presence_totals(routed: DataFrame) -> DataFrame:
    return routed.agg(
        F.count("*").alias("n_photos"),
        F.count_if(F.col("route") == "dogs").alias("only_dogs"),
        F.count_if(F.col("route") == "cats").alias("only_cats"),
        F.count_if(F.col("route") == "both").alias("both"),
        F.sum("dog_count").alias("n_dogs"),
        F.sum("cat_count").alias("n_cats"),
    )


def media_counts(media: DataFrame, faces: DataFrame, pets: DataFrame) -> DataFrame:
    """Faces and pets per media row, 0 where there are none."""

    def per(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("media_id").agg(F.count("*").alias(name))

    return (
        media.select("media_id")
        .join(per(faces, "face_count"), "media_id", "left")
        .join(per(pets, "pet_count"), "media_id", "left")
        .na.fill(0, ["face_count", "pet_count"])
    )


def pass_report(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Noise before a pass, rows it assigned, rows left, and the reduction in percent."""
    both = before.select(key, F.col("cluster_id").alias("_old")).join(
        after.select(key, F.col("cluster_id").alias("_new")), key
    )
    was, gone = F.col("_old").isNull(), F.col("_old").isNull() & F.col("_new").isNotNull()
    return both.agg(
        F.count_if(was).alias("noise_before"),
        F.count_if(gone).alias("assigned"),
        F.count_if(F.col("_new").isNull()).alias("remaining"),
        F.round(F.try_divide(F.count_if(gone) * 100.0, F.count_if(was)), 2).alias("percent"),
    )


def merge_report(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count("*").alias("merges"), F.count_distinct("target").alias("merge_groups")
    )


def sync_report(listing: DataFrame, root: str) -> DataFrame:
    """Conflict copies in a library and the sync provider its root points to."""
    conflicts = F.count_if(P.is_sync_conflict(F.col("path")))
    provider = P.sync_provider(F.lit(root))
    return listing.agg(conflicts.alias("total_conflicts")).select(
        provider.isNotNull().alias("is_cloud_synced"),
        provider.alias("provider"),
        "total_conflicts",
        F.concat_ws(
            " | ",
            F.when(provider.isNotNull(), "exclude generated folders from sync"),
            F.when(F.col("total_conflicts") > 0, "review conflict copies"),
        ).alias("recommendations"),
    )


def sync_conflicts(listing: DataFrame) -> DataFrame:
    return listing.where(P.is_sync_conflict(F.col("path"))).select("path")
