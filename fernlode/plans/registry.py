"""All queries of the engine's own operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernlode.plans import evidence_queries, graph_queries, misc_queries, navigation_queries, search_queries

_PARTS = (search_queries, evidence_queries, graph_queries, navigation_queries, misc_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
