"""Exact duplicates: which copies exist, which one stays, what is planned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import media as M
from shutterlake.functions import paths as P
from shutterlake.operators.ordering import number_rows
from shutterlake.operators.skew import skew_join
from shutterlake.session import materialize

MB = P.MB


def exact_groups(media: DataFrame, key: str = "sha256") -> DataFrame:
    """Keys held by more than one file; rows without a key never group."""
    return (
        media.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n_files"))
        .where(F.col("n_files") > 1)
    )


def _best(order: Sequence[Column], columns: Sequence[str]) -> Column:
    """Row with the smallest order tuple; a plain aggregate, so it combines map-side."""
    sort_key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return F.min_by(F.struct(*columns), sort_key)


# Resolution down, modification time up, path length up; the path settles ties.
def oldest_largest() -> list[Column]:
    return [-F.col("resolution"), F.col("mtime"), F.length("path"), F.col("path")]


def highest_score() -> list[Column]:
    return [-M.quality_score(F.col("resolution"), F.col("size_bytes")), F.col("path")]


def keep_best(
    media: DataFrame,
    key: str = "sha256",
    order: Sequence[Column] | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Pair every extra copy with the copy that stays.

    The winner per key is a map-side combined minimum, and only keys with more
    than one file reach the join. No step needs all rows of a key together.
    """
    keys = [*within, key]
    rows = media.where(F.col(key).isNotNull()).withColumn(
        "_score", M.quality_score(F.col("resolution"), F.col("size_bytes"))
    )
    best = (
        rows.groupBy(*keys)
        .agg(
            _best(order or oldest_largest(), ["path", "_score"]).alias("_keep"),
            F.count("*").alias("n_files"),
        )
        .where(F.col("n_files") > 1)
    )
    return (
        skew_join(rows, best, keys)
        .where(F.col("path") != F.col("_keep.path"))
        .select(
            *keys,
            F.col("_keep.path").alias("keep"),
            F.col("path").alias("duplicate"),
            F.col("_keep._score").alias("keep_score"),
            F.col("_score").alias("delete_score"),
            "size_bytes",
        )
    )


def as_pairs(plan: DataFrame) -> DataFrame:
    return plan.select(F.col("keep").alias("original"), "duplicate")


def _one_per_hash(files: DataFrame) -> DataFrame:
    """Greatest path per hash, with its score."""
    scored = files.where(F.col("sha256").isNotNull()).withColumn(
        "_score", M.quality_score(F.col("resolution"), F.col("size_bytes"))
    )
    return scored.groupBy("sha256").agg(
        F.max("path").alias("organized"), F.max_by("_score", "path").alias("organized_score")
    )


def reconcile(originals: DataFrame, organized: DataFrame) -> DataFrame:
    """Per original with an organized twin: keep the better copy, organized on ties."""
    scored = originals.where(F.col("sha256").isNotNull()).withColumn(
        "original_score", M.quality_score(F.col("resolution"), F.col("size_bytes"))
    )
    original_wins = F.col("original_score") > F.col("organized_score")
    return skew_join(scored, _one_per_hash(organized), ["sha256"]).select(
        "sha256",
        F.when(original_wins, F.col("path")).otherwise(F.col("organized")).alias("keep"),
        F.when(original_wins, F.col("organized")).otherwise(F.col("path")).alias("delete"),
        F.greatest("original_score", "organized_score").alias("keep_score"),
        F.least("original_score", "organized_score").alias("delete_score"),
        F.when(original_wins, "original_higher_quality")
        .otherwise("organized_kept")
        .alias("reason"),
    )


def unique_originals(originals: DataFrame, organized: DataFrame) -> DataFrame:
    """Hashed originals that exist nowhere in the organized tree."""
    have = organized.where(F.col("sha256").isNotNull()).select("sha256").distinct()
    hashed = originals.where(F.col("sha256").isNotNull())
    return skew_join(hashed, have, ["sha256"], "left_anti")


def match_duplicates(dups: DataFrame, organized: DataFrame) -> DataFrame:
    """Original of every file in the duplicates folder; null when unmatched."""
    found = _one_per_hash(organized).select("sha256", F.col("organized").alias("original"))
    files = dups.select("sha256", F.col("path").alias("duplicate"))
    # A null hash matches nothing and need not take part in the join.
    unread = files.where(F.col("sha256").isNull()).withColumn("original", F.lit(None).cast("string"))
    hashed = files.where(F.col("sha256").isNotNull())
    return skew_join(hashed, found, ["sha256"], "left").unionByName(unread)


def match_counts(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count("original").alias("matched"),
        F.count_if(F.col("original").isNull()).alias("unmatched"),
    )


def resolve_unknown(
    media: DataFrame, child: str = "Unknown", duplicates_dir: str = "duplicates"
) -> DataFrame:
    """Plan for files under <month>/Unknown.

    A file whose hash exists elsewhere in its month goes to the duplicates
    folder, any other is promoted to the month folder, and the Unknown folder
    itself is then listed for deletion. Expects columns path and sha256.
    """
    marker = f"/{child}/"
    inside = F.col("path").contains(marker)
    month = F.when(inside, F.substring_index(F.col("path"), marker, 1))
    unknown = media.where(inside).select("path", "sha256", month.alias("month_dir"))
    months = unknown.select("month_dir").distinct()
    # Siblings carry their month folder as a prefix. Folder and hash together are the
    # key: a folder near the root alone would hold nearly every file.
    sibling_dir = P.parent_dir(F.col("path"))
    depth = F.size(F.split(sibling_dir, "/"))
    ancestors = F.transform(
        F.sequence(F.lit(1), depth),
        lambda i: F.array_join(F.slice(F.split(sibling_dir, "/"), F.lit(1), i), "/"),
    )
    siblings = (
        media.where(~inside & F.col("sha256").isNotNull())
        .select(F.explode(ancestors).alias("month_dir"), "sha256")
        .distinct()
        .withColumn("_dup", F.lit(True))
    )
    name = P.file_name(F.col("path"))
    keys = ["month_dir", "sha256"]
    hashed = skew_join(unknown.where(F.col("sha256").isNotNull()), siblings, keys, "left")
    unread = unknown.where(F.col("sha256").isNull()).withColumn("_dup", F.lit(None).cast("boolean"))
    files = hashed.unionByName(unread).select(
        F.when(F.col("_dup"), "move_to_duplicates").otherwise("move_to_parent").alias("action"),
        F.col("path").alias("src"),
        F.when(F.col("_dup"), F.concat(F.lit(duplicates_dir + "/"), name))
        .otherwise(F.concat_ws("/", "month_dir", name))
        .alias("dst"),
        F.when(F.col("_dup"), "hash exists in month folder")
        .otherwise("no sibling with this hash")
        .alias("reason"),
    )
    folders = months.select(
        F.lit("delete_folder").alias("action"),
        F.concat_ws("/", "month_dir", F.lit(child)).alias("src"),
        F.lit(None).cast("string").alias("dst"),
        F.lit("folder is empty after the moves").alias("reason"),
    )
    return files.unionByName(folders)


def pair_existence(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Which side of each pair is still on disk, with hash and size of both."""
    have = manifest.select("path", "sha256", "size_bytes")

    def side(name: str) -> DataFrame:
        return have.select(
            F.col("path").alias(name),
            F.lit(True).alias(f"{name}_exists"),
            F.col("sha256").alias(f"{name}_sha256"),
            F.col("size_bytes").alias(f"{name}_bytes"),
        )

    both = pairs.join(side("original"), "original", "left").join(
        side("duplicate"), "duplicate", "left"
    )
    return both.withColumns(
        {
            "original_exists": F.coalesce("original_exists", F.lit(False)),
            "duplicate_exists": F.coalesce("duplicate_exists", F.lit(False)),
        }
    ).withColumn("hashes_match", F.col("original_sha256") == F.col("duplicate_sha256"))


def existing_pairs(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("original_exists") & F.col("duplicate_exists"))


def existence_counts(checked: DataFrame) -> DataFrame:
    """Pairs per category with their share in percent."""
    category = (
        F.when(F.col("original_exists") & F.col("duplicate_exists"), "both")
        .when(F.col("original_exists"), "only_original")
        .when(F.col("duplicate_exists"), "only_duplicate")
        .otherwise("neither")
    )
    counts = checked.groupBy(category.alias("category")).agg(F.count("*").alias("n_pairs"))
    total = counts.agg(F.sum("n_pairs").alias("_total")).withColumn("_one", F.lit(1))
    return (
        counts.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select(
            "category",
            "n_pairs",
            F.round(F.col("n_pairs") * 100.0 / F.col("_total"), 2).alias("percent"),
        )
    )


def verify_sample(checked: DataFrame, n: int = 10) -> DataFrame:
    """First n pairs with their hash comparison."""
    return (
        checked.select("original", "duplicate", "hashes_match")
        .orderBy("original", "duplicate")
        .limit(n)
    )


def group_summary(checked: DataFrame, sample: int = 3) -> DataFrame:
    """Per original: files incl. itself, MB of what exists, first duplicates; largest first."""
    existing_bytes = F.sum(F.when(F.col("duplicate_exists"), F.col("duplicate_bytes")).otherwise(0))
    totals = checked.groupBy("original").agg(
        (F.count("*") + 1).alias("n_files"),
        (existing_bytes + F.coalesce(F.max("original_bytes"), F.lit(0))).alias("_bytes"),
    )
    firsts = first_per_group(
        checked.select("original", "duplicate"), ["original"], [F.col("duplicate").asc()], sample
    )
    lists = firsts.groupBy("original").agg(
        F.array_sort(F.collect_list("duplicate")).alias("first_files")
    )
    return (
        totals.join(lists, "original")
        .select(
            "original",
            "n_files",
            F.round(F.col("_bytes") / F.lit(MB), 2).alias("size_mb"),
            F.col("first_files"),
        )
        .orderBy(F.desc("size_mb"), "original")
    )


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """First n rows per group.

    Filtering on the row number directly lets Spark trim every group to n rows
    before the shuffle (WindowGroupLimit), so a hot group stays small.
    """
    w = W.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    )


def totals(checked: DataFrame) -> DataFrame:
    """Files in the list, distinct originals, bytes wasted by existing duplicates."""
    wasted = F.sum(F.when(F.col("duplicate_exists"), F.col("duplicate_bytes")).otherwise(0))
    return checked.agg(
        F.count("*").alias("n_duplicates"),
        F.count_distinct("original").alias("n_groups"),
        F.coalesce(wasted, F.lit(0)).alias("wasted_bytes"),
        F.round(F.coalesce(wasted, F.lit(0)) / F.lit(MB), 2).alias("wasted_mb"),
        F.round(F.coalesce(wasted, F.lit(0)) / F.lit(MB * 1024), 2).alias("wasted_gb"),
    )


def wasted_per(plan: DataFrame, by: str) -> DataFrame:
    return plan.groupBy(by).agg(
        F.count("*").alias("n_removable"), F.sum("size_bytes").alias("wasted_bytes")
    )


def folder_summary(plan: DataFrame, top: int = 10) -> DataFrame:
    """Folders with the most removable files, plus how many folders follow."""
    counts = plan.groupBy(P.parent_dir(F.col("duplicate")).alias("folder")).agg(
        F.count("*").alias("n_duplicates")
    )
    n = counts.agg(F.count("*").alias("_folders")).withColumn("_one", F.lit(1))
    head = counts.orderBy(F.desc("n_duplicates"), "folder").limit(top).withColumn("_one", F.lit(1))
    return head.join(F.broadcast(n), "_one").select(
        "folder", "n_duplicates", F.greatest(F.col("_folders") - top, F.lit(0)).alias("more_folders")
    )


def dedup_summary(media: DataFrame, key: str = "sha256") -> DataFrame:
    """Sets with copies, removable files, distinct contents and percent removable."""
    per = media.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    removable = F.sum(F.col("_n") - 1)
    return per.agg(
        F.count_if(F.col("_n") > 1).alias("duplicate_sets"),
        removable.alias("removable"),
        F.count("*").alias("unique_files"),
        F.round(removable * 100.0 / F.sum("_n"), 2).alias("percent"),
    )


def file_totals(media: DataFrame) -> DataFrame:
    size = F.sum("size_bytes")
    return media.agg(
        F.count("*").alias("n_files"),
        size.alias("bytes"),
        F.round(size / F.lit(MB), 2).alias("mb"),
        F.round(size / F.lit(MB * 1024), 2).alias("gb"),
    )


# How each style writes its number, as a pattern over (stem)(number)(suffix).
NUMBERED = {
    "plain": r"^(.+)_([0-9]+)(\.[^.]+)?$",
    "dup": r"^(.+)_dup([0-9]+)(\.[^.]+)?$",
    "paren": r"^(.+) \(([0-9]+)\)(\.[^.]+)?$",
}


def _free_numbers(todo: DataFrame, taken: DataFrame, style: str) -> DataFrame:
    """The r-th file of a (folder, name) gets the r-th number nobody uses.

    A used number t that is the i-th smallest has t-(i-1) free numbers below it.
    Sorting the files by their rank and the used numbers by that count puts
    every file right behind the used numbers it has to jump over, so its
    position in the merged order is its number.
    """
    rx = NUMBERED[style]
    name = F.col("name")
    used = taken.select("folder", name, F.lit(0).cast("long").alias("t")).unionByName(
        taken.where(name.rlike(rx)).select(
            "folder",
            F.concat(F.regexp_extract(name, rx, 1), F.regexp_extract(name, rx, 3)).alias("name"),
            F.regexp_extract(name, rx, 2).try_cast("long").alias("t"),
        )
    )
    wanted = todo.select("folder", "name").distinct()
    used = used.where("t is not null").distinct().join(wanted, ["folder", "name"], "left_semi")
    used = materialize(used)
    if used.isEmpty():
        return number_rows(todo, ["folder", "name"], [F.col("src").asc()], "_rn").select(
            "folder", "name", "src", (F.col("_rn") - 1).alias("number")
        )
    used = number_rows(used, ["folder", "name"], [F.col("t").asc()], "_i").select(
        "folder",
        "name",
        F.lit(None).cast("string").alias("src"),
        (F.col("t") - F.col("_i") + 1).alias("_at"),
        F.lit(0).alias("_kind"),
        F.col("t").alias("_tie"),
    )
    files = number_rows(todo, ["folder", "name"], [F.col("src").asc()], "_rn").select(
        "folder",
        "name",
        "src",
        (F.col("_rn") - 1).alias("_at"),
        F.lit(1).alias("_kind"),
        F.col("_rn").alias("_tie"),
    )
    order = [F.col("_at").asc(), F.col("_kind").asc(), F.col("_tie").asc()]
    merged = number_rows(files.unionByName(used), ["folder", "name"], order, "_pos")
    return merged.where(F.col("src").isNotNull()).select(
        "folder", "name", "src", (F.col("_pos") - 1).alias("number")
    )


def number_collisions(
    plan: DataFrame, existing: DataFrame, style: str = "plain"
) -> DataFrame:
    """Give every planned file (folder, name, src) a free name in its folder.

    Files of one name take free suffixes in `src` order. Two different names can
    still meet in one target (`a_1.jpg` and the copy of `a.jpg`); the bare name
    wins and the other goes into the next round. Every round places at least one
    file of each contested target, so the loop ends with all placed.
    """
    taken = existing.select("folder", "name").distinct()
    todo = plan.select("folder", "name", "src")
    placed = None
    while True:
        tried = _free_numbers(todo, taken, style).withColumn(
            "target", P.suffixed_name(F.col("name"), F.col("number"), style)
        )
        rank = F.struct("number", "src")
        winner = tried.groupBy("folder", "target").agg(F.min(rank).alias("_winner"))
        tried = materialize(
            tried.join(winner, ["folder", "target"]).select(
                "folder", "name", "src", "target", (F.col("_winner") == rank).alias("_ok")
            )
        )
        done = tried.where("_ok").drop("_ok")
        placed = done if placed is None else placed.unionByName(done)
        todo = tried.where(~F.col("_ok")).select("folder", "name", "src")
        if todo.isEmpty():
            return placed
        taken = taken.unionByName(done.select("folder", F.col("target").alias("name"))).distinct()


def hash_distance_counts(
    media: DataFrame, order: Column, sample: int = 500, column: str = "phash"
) -> DataFrame:
    """Distances between all pairs of a sample of hashes, counted per distance.

    The sample size is the feature: 500 hashes give at most 124,750 pairs. They
    are held in one array and each is compared with those behind it.
    """
    picked = media.where(F.col(column).isNotNull()).orderBy(order).limit(sample)
    packed = picked.agg(F.collect_list(column).alias("_h"))
    pairs = packed.select("_h", F.posexplode("_h").alias("_i", "_a")).select(
        "_a", F.explode(F.slice("_h", F.col("_i") + 2, F.lit(sample))).alias("_b")
    )
    return pairs.groupBy(M.hamming64(F.col("_a"), F.col("_b")).cast("int").alias("distance")).agg(
        F.count("*").alias("n_pairs")
    )


def hash_distance_stats(counts: DataFrame) -> DataFrame:
    """Index percentiles from the at most 65 distance counts, and the threshold they suggest."""
    # At most 65 rows: one window task is enough.
    upto = W.partitionBy(F.lit(0)).orderBy("distance").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(F.lit(0))
    cum = counts.withColumn("_to", F.sum("n_pairs").over(upto)).withColumn(
        "_n", F.sum("n_pairs").over(whole)
    )

    def at(index: Column) -> Column:
        """Distance at a zero-based index of the sorted list."""
        return F.min(F.when(F.col("_to") > index, F.col("distance")))

    def pct(p: float) -> Column:
        return at(F.greatest(F.lit(0), F.floor(F.lit(p) * F.col("_n")).cast("long") - 1))

    n = F.col("_n")
    middle = (
        at(F.floor((n - 1) / 2).cast("long")) + at(F.floor(n / 2).cast("long"))
    ) / 2
    stats = cum.agg(
        F.sum("n_pairs").alias("count"),
        F.min("distance").alias("min"),
        F.max("distance").alias("max"),
        F.floor(middle).cast("int").alias("median"),
        pct(0.10).alias("p10"),
        pct(0.25).alias("p25"),
        pct(0.75).alias("p75"),
        pct(0.90).alias("p90"),
    )
    return stats.withColumn(
        "recommended_threshold",
        F.greatest(F.lit(4), F.least(F.col("p25") - 2, F.col("median") - 4)),
    )


def hash_distance_histogram(counts: DataFrame, width: int = 2) -> DataFrame:
    low = (F.floor(F.col("distance") / width) * width).cast("int")
    return (
        counts.groupBy(low.alias("_low"))
        .agg(F.sum("n_pairs").alias("n_pairs"))
        .select(
            F.concat_ws("-", F.col("_low"), F.col("_low") + (width - 1)).alias("bucket"), "n_pairs"
        )
    )
