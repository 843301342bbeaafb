"""Column rules shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and line rules: space and the controls 9 to 13.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """Maximal runs of other characters than white space."""
    return F.array_remove(F.split(c, f"[{SPACE}]+"), "")
