"""All queries of the library outside the llm subpackage, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis, choices, dashboard, endpoints, jobs, relational, reports  # noqa: F401  (each registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(relational.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(relational.SQL)
