"""Queries by name, with the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, jobs  # noqa: F401  jobs adds its queries to the catalogue


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
