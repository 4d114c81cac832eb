"""Queries and SQL of the text operators, collected by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontamination, exact_dedup, jaccard_join, language_id, license_scan, media_columns, quality, spelling, substring_dedup, token_codec, toxicity, url_filter, whitening

_MODULES = (license_scan, url_filter, media_columns, token_codec, language_id, substring_dedup, toxicity, decontamination, jaccard_join, quality, exact_dedup, whitening, spelling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express a query."""
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
