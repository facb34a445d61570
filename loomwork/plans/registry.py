"""Named queries over the test tables and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans import fold_queries, measure_queries, model_queries, service_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for part in (text_queries, fold_queries, measure_queries, service_queries, model_queries, table_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
FLAGSHIP = "class_tfidf_top_terms"
