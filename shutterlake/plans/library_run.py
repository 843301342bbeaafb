"""Full library run: locate, plan folders, exact duplicates, bursts, events."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import paths as P
from shutterlake.operators import bursts as B
from shutterlake.operators import dedup as D
from shutterlake.operators import timeline as T
from shutterlake.session import materialize


class LibraryRun(NamedTuple):
    media: DataFrame
    folders: DataFrame
    duplicates: DataFrame
    bursts: DataFrame
    events: DataFrame


def organize(media: DataFrame, root: str = "Organized") -> DataFrame:
    """Target folder and name per file, before collisions are numbered."""
    folder = F.concat_ws(
        "/",
        F.lit(root),
        P.target_folder(F.col("ts"), F.col("location_name"), F.col("size_bytes"), F.col("mtime")),
    )
    return media.select(
        folder.alias("folder"), P.file_name(F.col("path")).alias("name"), F.col("path").alias("src")
    )


def run_library(
    media: DataFrame, cache: DataFrame, existing: DataFrame, max_hamming: int = 6
) -> LibraryRun:
    """One pass over a media table (ts, gps, sha256, phash, resolution, size_bytes, mtime, path)."""
    located = materialize(T.attach_location(media, cache))
    return LibraryRun(
        media=located,
        folders=D.number_collisions(organize(located), existing),
        duplicates=D.as_pairs(D.keep_best(located)),
        bursts=B.group_similar(located, max_hamming),
        events=T.segment_events(located),
    )
