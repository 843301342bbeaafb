"""Tag maps, probe JSON, galleries and detection arrays turned into typed rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake import schemas
from shutterlake.functions import media as M
from shutterlake.functions import vectors as V


def exif_tags(df: DataFrame) -> DataFrame:
    """Columns tags, gps and mtime become `ts` and `position`."""
    return df.withColumn("ts", M.exif_datetime(F.col("tags"), F.col("mtime"))).withColumn(
        "position", M.exif_gps(F.col("gps"))
    )


def video_tags(df: DataFrame, column: str = "probe") -> DataFrame:
    """Typed columns from probe JSON; container tags come before stream tags."""
    probe = F.from_json(F.col(column), schemas.PROBE)
    fmt, stream = F.col("_p.format"), F.col("_v")
    return (
        df.withColumn("_p", probe)
        .withColumn("_v", M.first_video_stream(F.col("_p.streams")))
        .withColumns(
            {
                "duration": fmt["duration"].try_cast("double"),
                "bitrate": fmt["bit_rate"].try_cast("long"),
                "creation_time": F.coalesce(
                    M.video_creation_time(fmt["tags"]), M.video_creation_time(stream["tags"])
                ),
                "position": F.coalesce(M.video_gps(fmt["tags"]), M.video_gps(stream["tags"])),
                "width": stream["width"],
                "height": stream["height"],
                "resolution": stream["width"].cast("long") * stream["height"].cast("long"),
                "codec": stream["codec_name"],
                "fps": M.frame_rate(stream["r_frame_rate"]),
            }
        )
        .drop("_p", "_v")
    )


def gallery_from_list(df: DataFrame, column: str) -> DataFrame:
    """[{label, embedding}, ...] to rows, with the list position."""
    return _gallery(df, F.from_json(F.col(column), schemas.GALLERY_LIST))


def gallery_from_columns(df: DataFrame, column: str) -> DataFrame:
    """{labels: [...], embeddings: [[...], ...]} to rows, with the list position."""
    raw = F.from_json(F.col(column), schemas.GALLERY_COLUMNS)
    pairs = F.arrays_zip(raw["labels"].alias("label"), raw["embeddings"].alias("embedding"))
    return _gallery(df, pairs)


def _gallery(df: DataFrame, entries) -> DataFrame:
    others = [c for c in df.columns]
    return (
        df.select(*others, F.posexplode(entries).alias("position", "_e"))
        .select(*others, "position", F.col("_e.label"), F.col("_e.embedding"))
        .where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    )


def flatten_detections(
    df: DataFrame,
    array_col: str,
    min_conf: float,
    labels: Iterable[str] | None = None,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """One row per detection with its position; empty embeddings are dropped.

    The array is filtered before it is exploded, so rejected detections never
    become rows, and `embedding_index` numbers the accepted ones.
    """

    def wanted(d):
        ok = (d["confidence"] >= min_conf) & V.usable_vector(d["embedding"])
        if labels is not None:
            ok = ok & d["label"].isin(*labels)
        if exclude:
            ok = ok & ~d["label"].isin(*exclude)
        return ok

    others = [c for c in df.columns if c != array_col]
    return df.select(
        *others, F.posexplode(F.filter(F.col(array_col), wanted)).alias("embedding_index", "_d")
    ).select(*others, "embedding_index", "_d.*")


def label_set(df: DataFrame, array_col: str) -> DataFrame:
    """Distinct labels per image."""
    return df.withColumn(
        "labels", F.array_sort(F.array_distinct(F.transform(F.col(array_col), lambda d: d["label"])))
    )
