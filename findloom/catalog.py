"""Registered queries over the supplied tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from findloom.plans import finding_queries, merge_queries, run_queries, site_queries, table_queries, url_queries

_ALL = url_queries.QUERIES | table_queries.QUERIES | finding_queries.QUERIES | merge_queries.QUERIES | run_queries.QUERIES | site_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
