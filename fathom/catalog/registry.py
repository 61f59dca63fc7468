"""Registration of queries and small helpers for their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .standins import with_views
from .workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over a workspace, with the SQL that must return the same rows if there is one."""

    def register(build: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(workspace(spark, folder))
        if sql:
            CHECKS[name] = with_views(sql)
        return build

    return register


def rounded(expression: str, digits: int) -> str:
    """The engine's rounding, in SQL."""
    return f"FLOOR(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def exact_sum_sql(expression: str, scale: int = 8) -> str:
    return f"CAST(SUM(CAST({expression} AS DECIMAL({14 + scale},{scale}))) AS DOUBLE)"


def exact_avg_sql(expression: str, scale: int = 8) -> str:
    return f"{exact_sum_sql(expression, scale)} / NULLIF(COUNT({expression}), 0)"


def percent_sql(expression: str) -> str:
    """Percent text with up to two digits and no trailing zeros, in SQL."""
    value = rounded(f"CAST({expression} AS DOUBLE) * 100", 2)
    return number_sql(value)


def number_sql(rounded_value: str) -> str:
    return f"REGEXP_REPLACE(CAST(CAST({rounded_value} AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '')"
