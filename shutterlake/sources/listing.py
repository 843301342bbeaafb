"""File listings: metadata only; content is read only to be hashed, in chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import paths as P
from shutterlake.operators import kernels

# Extensions of the image-only index scan and of labelled folders.
INDEX_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".tif", ".webp", ".heic", ".heif",
)
LABELLED_EXTENSIONS = (".jpg", ".jpeg", ".png")

CHUNK_BYTES = 64 * 1024


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root as path, length and modificationTime."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", "modificationTime")
    )


def select_media(
    listing: DataFrame,
    extensions: Iterable[str] | None = P.MEDIA_EXTENSIONS,
    skip_prefixes: Iterable[str] = (),
    excluded_parts: Iterable[str] = (),
) -> DataFrame:
    """Keep wanted extensions outside skipped subtrees and excluded folder names."""
    path = F.col("path")
    keep = F.lit(True)
    if extensions is not None:
        keep = keep & P.has_extension(path, extensions)
    if skip_prefixes:
        keep = keep & ~P.under(path, skip_prefixes)
    if excluded_parts:
        keep = keep & ~P.has_part(path, excluded_parts)
    return listing.where(keep)


def media_listing(spark: SparkSession, root: str, **selection) -> DataFrame:
    return select_media(file_listing(spark, root), **selection)


def capped_images(listing: DataFrame, max_files: int) -> DataFrame:
    """First files by path, one row per file whatever the case of its suffix."""
    return select_media(listing, INDEX_EXTENSIONS).orderBy("path").limit(max_files)


def unknown_folders(listing: DataFrame, word: str = "unknown") -> DataFrame:
    """Distinct folders whose own name contains the word, in any case."""
    folder = P.parent_dir(F.col("path"))
    return (
        listing.select(folder.alias("folder"))
        .where(F.lower(P.file_name(F.col("folder"))).contains(word))
        .distinct()
    )


def month_folders(listing: DataFrame, root: str, child: str = "Unknown") -> DataFrame:
    """root/<year>/<month> folders that hold the child folder."""
    depth = len(root.rstrip("/").split("/"))
    parts = F.split(F.col("path"), "/")
    return (
        listing.where(F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")))
        .where((F.get(parts, F.lit(depth + 2)) == child) & (F.size(parts) > depth + 3))
        .select(
            F.get(parts, F.lit(depth)).alias("year"),
            F.get(parts, F.lit(depth + 1)).alias("month"),
        )
        .distinct()
    )


def empty_folders(dirs: DataFrame, files: DataFrame, name: str = "Unknown") -> DataFrame:
    """Folders with exactly this name; `is_empty` when no file or folder is their child."""
    wanted = dirs.where(P.file_name(F.col("path")) == name).select("path").distinct()
    children = (
        files.select(P.parent_dir(F.col("path")).alias("path"))
        .unionByName(dirs.select(P.parent_dir(F.col("path")).alias("path")))
        .groupBy("path")
        .agg(F.count("*").alias("children"))
    )
    return wanted.join(children, "path", "left").select(
        "path",
        F.coalesce("children", F.lit(0)).alias("children"),
        F.col("children").isNull().alias("is_empty"),
    )


def labelled(listing: DataFrame) -> DataFrame:
    """Class label = name of the parent folder."""
    parts = F.split(F.col("path"), "/")
    return select_media(listing, LABELLED_EXTENSIONS).withColumn(
        "label", F.try_element_at(parts, F.lit(-2))
    )


def hashed_content(spark: SparkSession, root: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Listing plus SHA-256, for files of any size.

    Only paths are listed; executors read each file in chunks, so neither a row
    nor a task ever holds a whole file. Files are dealt out evenly first, since a
    listing says nothing about how long a file takes.
    """
    files = file_listing(spark, root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[kernels.file_sha256(p, chunk_bytes) for p in batch["path"]])

    dealt = files.repartition("path")
    return dealt.mapInPandas(run, "path string, length bigint, modificationTime timestamp, sha256 string")
