"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import extra, extra_sql
from lexmill.plans.queries import QUERIES
from lexmill.plans.sql import oracle_sql as _sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return QUERIES | extra.QUERIES


def oracle_sql() -> dict[str, str]:
    return _sql() | extra_sql.oracle_sql()
