"""Incremental re-scan, child replacement, triplets, splits and the model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.ordering import number_rows
from shutterlake.operators.skew import skew_join
from shutterlake.session import materialize

MTIME_TOLERANCE_S = 1.0


def changed(listing: DataFrame, media: DataFrame, tolerance_s: float = MTIME_TOLERANCE_S) -> DataFrame:
    """Files that are new, were never scanned, or differ in mtime by more than the tolerance."""
    known = media.select("path", "last_scanned_at", F.lit(True).alias("_known"))
    both = listing.join(known, "path", "left")

    def seconds(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) / 1e6

    drift = F.abs(seconds(F.col("modificationTime")) - seconds(F.col("last_scanned_at")))
    return both.select(
        *listing.columns,
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("last_scanned_at").isNull(), "never_scanned")
        .when(drift > tolerance_s, "modified")
        .alias("reason"),
    ).where(F.col("reason").isNotNull())


def upsert(
    media: DataFrame, new: DataFrame, key: str = "path", order: str | None = None
) -> DataFrame:
    """New rows replace those with the same key.

    Of several new rows of one key the last by `order` stays, without it, or at
    the same place, the greatest row.
    """
    rest = [c for c in new.columns if c not in (key, order)]
    rank = F.struct(*([order] if order else []), *rest)
    one = new.groupBy(key).agg(F.max(rank).alias("_row")).select(key, "_row.*")
    return media.join(one.select(key), key, "left_anti").unionByName(one)


def replace_children(
    children: DataFrame, parents: DataFrame, new: DataFrame, key: str = "media_id"
) -> DataFrame:
    """Child rows of changed parents are dropped and the new ones added."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def with_media_path(members: DataFrame, media: DataFrame) -> DataFrame:
    """Members with their file path; `failed` marks those whose media row is missing."""
    return members.join(media.select("media_id", "path"), "media_id", "left").withColumn(
        "failed", F.col("path").isNull()
    )


def hash_number(*parts: Column) -> Column:
    """Reproducible non-negative number from the parts (60 bits of their MD5)."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split(df: DataFrame, key: str, pct: int = 20, seed: int = 42) -> DataFrame:
    """Add `part` (test or train); a row's side depends on its key and the seed only."""
    bucket = F.pmod(hash_number(F.lit(seed), F.col(key)), F.lit(100))
    return df.withColumn("part", F.when(bucket < pct, "test").otherwise("train"))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded hash order."""
    return df.orderBy(hash_number(F.lit(seed), F.col(key)), key).limit(n)


def mine_triplets(
    df: DataFrame, key: str = "id", label: str = "label", per_row: int = 10, seed: int = 42
) -> DataFrame:
    """(anchor, draw, positive, negative): per anchor `per_row` seeded draws.

    All rows are numbered once in label order, so every label owns a range of
    positions. A positive is another position of the anchor's range, a negative
    a position outside it: both are plain equi-joins, whatever the label sizes.
    Labels with one member have no positive and give no triplet.
    """
    rows = number_rows(df.select(key, label), [], [F.col(label).asc(), F.col(key).asc()], "_pos")
    rows = materialize(rows.withColumn("_pos", F.col("_pos") - 1))
    ranges = rows.groupBy(label).agg(F.min("_pos").alias("_from"), F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all")).withColumn("_one", F.lit(1))
    draws = (
        skew_join(rows, ranges, [label])
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .where((F.col("_n") > 1) & (F.col("_n") < F.col("_all")))
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    )

    def number(kind: str) -> Column:
        return hash_number(F.lit(seed), F.col(key), F.col("draw"), F.lit(kind))

    step = F.pmod(number("p"), F.col("_n") - 1) + 1
    positive = F.col("_from") + F.pmod(F.col("_pos") - F.col("_from") + step, F.col("_n"))
    other = F.pmod(number("n"), F.col("_all") - F.col("_n"))
    negative = F.when(other < F.col("_from"), other).otherwise(other + F.col("_n"))
    picks = draws.select(
        F.col(key).alias("anchor"), "draw", positive.alias("_p"), negative.alias("_q")
    )
    p = rows.select(F.col("_pos").alias("_p"), F.col(key).alias("positive"))
    q = rows.select(F.col("_pos").alias("_q"), F.col(key).alias("negative"))
    return picks.join(p, "_p").join(q, "_q").select("anchor", "draw", "positive", "negative")


def embed(
    df: DataFrame, fn: Callable[[pd.DataFrame], list], key: str = "id"
) -> DataFrame:
    """(key, embedding, error): run a user's model over Arrow batches of rows.

    `fn` gets a pandas batch and returns one vector, or None, per row. A batch
    that raises is retried row by row so that one bad file costs one row.
    """

    def rows(batch: pd.DataFrame) -> list[tuple]:
        try:
            return [(v, None if v is not None else "no vector") for v in fn(batch)]
        except Exception as whole:
            if len(batch) == 1:
                return [(None, str(whole))]
            return [rows(batch.iloc[i : i + 1])[0] for i in range(len(batch))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = rows(batch)
            yield pd.DataFrame(
                {
                    key: batch[key],
                    "embedding": [None if v is None else [float(x) for x in v] for v, _ in done],
                    "error": [e for _, e in done],
                }
            )

    kind = df.schema[key].dataType.simpleString()
    return df.mapInPandas(run, f"{key} {kind}, embedding array<float>, error string")
