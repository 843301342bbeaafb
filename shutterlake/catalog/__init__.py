"""Registered queries: a Spark callable per operator and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    from shutterlake.catalog import core, files, people, review, streams, timeline, vectors  # noqa: F401

    return dict(core.QUERIES), dict(core.ORACLES)
