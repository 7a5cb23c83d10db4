"""Registered queries of the session-analytics library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import sessions_catalog
from .plans.catalog import QUERIES, SQL

assert sessions_catalog.query  # the module registers its queries where it is imported


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
