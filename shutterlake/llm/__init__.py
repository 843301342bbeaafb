"""Operators for training-data pipelines. Nothing outside this folder imports it but the entry file."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Task code travels with its tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    """The queries by name, and the SQL of those that SQL can express."""
    from shutterlake.llm import (
        bpe,
        fill_middle,
        fingerprints,
        line_dedup,
        merkle,
        ngram_join,
        packing,
        pii,
        quality,
        super_minhash,
        token_counts,
        token_files,
        url_filters,
    )

    queries = {
        "op1_url_filters": url_filters.query,
        "op2_line_dedup": line_dedup.query,
        "op3_token_counts": token_counts.query,
        "op4_personal_data": pii.query,
        "op5_fingerprints": fingerprints.query,
        "op6_ngram_join": ngram_join.query,
        "op7_packing": packing.query,
        "op8_bpe": bpe.query,
        "op9_token_files": token_files.query,
        "op10_quality_rules": quality.query,
        "op11_fill_middle": fill_middle.query,
        "op12_merkle_manifest": merkle.query,
        "op13_near_duplicates": super_minhash.query,
    }
    sql = {
        "op1_url_filters": url_filters.SQL,
        "op2_line_dedup": line_dedup.SQL,
        "op6_ngram_join": ngram_join.SQL,
        "op10_quality_rules": quality.SQL,
        "op11_fill_middle": fill_middle.SQL,
        "op12_merkle_manifest": merkle.SQL,
        "op13_near_duplicates": super_minhash.SQL,
    }
    return queries, sql
