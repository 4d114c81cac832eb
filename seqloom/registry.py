"""Queries and SQL of everything but the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.queries import records, series, traces

_MODULES = (traces, series, records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator."""
    return {name: f for m in _MODULES for name, f in m.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express a query."""
    return {name: sql for m in _MODULES for name, sql in m.query.sql.items()}
