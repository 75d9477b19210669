"""All queries of the engine's own operators over the driver's tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import metric_queries, search_queries, store_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.search_budget(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return search_queries.QUERIES | store_queries.QUERIES | metric_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return search_queries.SQL | store_queries.SQL | metric_queries.SQL
