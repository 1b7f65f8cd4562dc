"""Queries of the engine's own operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import on_documents, on_examples, on_places, on_time, on_warehouse

Query = Callable[[SparkSession, str], DataFrame]

_ALL: dict[str, tuple[Query, str]] = on_documents.QUERIES | on_time.QUERIES | on_places.QUERIES | on_warehouse.QUERIES | on_examples.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
