"""Queries by name, with their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import match_queries, transform_queries

PARTS = (transform_queries, match_queries)
flagship = match_queries.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.oracle_sql().items()}
