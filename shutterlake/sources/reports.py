"""Pair lists, report files, lookup tables and stored entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake import schemas


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Trim both cells and skip rows where either is blank."""
    return pairs.select(
        F.trim("original").alias("original"), F.trim("duplicate").alias("duplicate")
    ).where((F.col("original") != "") & (F.col("duplicate") != ""))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return clean_pairs(spark.read.csv(path, header=True, schema=schemas.PAIRS))


def write_pairs(pairs: DataFrame, *paths: str) -> None:
    for path in paths:
        pairs.select("original", "duplicate").write.mode("overwrite").csv(path, header=True)


# JSON keeps milliseconds by default; reports keep the full time.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, nested columns kept."""
    df.write.mode("overwrite").option("timestampNTZFormat", TIME_FORMAT).json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("timestampNTZFormat", TIME_FORMAT).json(path)


def write_plan(plan: DataFrame, path: str) -> None:
    """Audit copy of a plan: one row per kept/removed pair with its reason."""
    plan.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, base: str, version: str) -> str:
    """Entity tables are replaced by writing a new version folder."""
    target = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def geocode_cache(spark: SparkSession, path: str) -> DataFrame:
    """JSON object "lat,lon" -> address as (key, address) rows."""
    text = spark.read.text(path, wholetext=True)
    return cache_entries(text, "value")


def cache_entries(df: DataFrame, column: str) -> DataFrame:
    return df.select(
        F.explode(F.from_json(F.col(column), "MAP<STRING,STRING>")).alias("key", "address")
    )


def write_geocode_cache(cache: DataFrame, path: str) -> None:
    """One JSON object per line, readable as a lookup table of any size."""
    cache.select("key", "address").write.mode("overwrite").json(path)


def review_decisions(decisions: DataFrame) -> DataFrame:
    """Decision rows stamped with the totals of their review session.

    One row per decision: the totals are broadcast (a single row), so the list
    of decisions never has to fit into one record.
    """
    totals = decisions.agg(
        F.max("reviewed_at").alias("timestamp"),
        F.count("*").alias("totalSets"),
        F.count_if(~F.col("keepOriginal") | ~F.col("keepDuplicate")).alias("reviewed"),
    )
    rows = decisions.select(
        "original",
        "duplicate",
        "keepOriginal",
        "keepDuplicate",
    ).withColumn("_one", F.lit(1))
    return rows.join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def reset_clusters(faces: DataFrame) -> DataFrame:
    """Detach every row from its cluster."""
    return faces.withColumn("cluster_id", F.lit(None).cast("long"))


def without_species(pets: DataFrame, species: str) -> DataFrame:
    """Rows that stay when one species is deleted."""
    return pets.where(F.col("species").isNull() | (F.col("species") != species))
