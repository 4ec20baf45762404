"""All queries of the library but the training-data operators', and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import composite_queries, corpus_queries, scalar_queries, state_queries, turn_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**turn_queries.QUERIES, **corpus_queries.QUERIES, **state_queries.QUERIES, **scalar_queries.QUERIES, **composite_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**turn_queries.ORACLE, **corpus_queries.ORACLE, **state_queries.ORACLE, **scalar_queries.ORACLE, **composite_queries.ORACLE}
