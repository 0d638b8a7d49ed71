"""All queries of the core with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import graph_queries, log_queries, quality_queries, review_queries, source_queries, upkeep_queries

_ALL = {k: v for m in (graph_queries, log_queries, quality_queries, upkeep_queries, review_queries, source_queries) for k, v in m.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
