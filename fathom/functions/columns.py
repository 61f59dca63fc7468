"""Choosing and transforming columns by name, type or position."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_except(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def select_unique(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Select by a list of names in which a repeated name counts once."""
    return df.select(*names_sql(dict.fromkeys(names)))


def column_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """The columns from ``first`` to ``last`` in table order."""
    names = df.columns
    return df.select(*names_sql(names[names.index(first) : names.index(last) + 1]))


def map_columns(df: DataFrame, names: Iterable[str], change: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({n: change(quoted(n)) for n in names})


def name_sql(name: str) -> str:
    """A column name as SQL text; it may hold dots or spaces.

    Wide tables build their expressions as SQL text: one call to the JVM per column, not one per operator.
    """
    return "`" + name.replace("`", "``") + "`"


def names_sql(names: Iterable[str]) -> list[str]:
    return [name_sql(n) for n in names]


def number_literal(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{float(value)!r}' AS DOUBLE)"


def text_literal(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    """A column whose name may hold dots or spaces."""
    return F.col(name_sql(name))


def pull(df: DataFrame, column: str, limit: int = 10000) -> list:
    """The distinct values of a small column as a list; refuses more than ``limit``."""
    rows = df.select(quoted(column).alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values")
    return sorted((r.v for r in rows), key=lambda v: (v is None, v))


def as_doubles(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """The kept columns as they are and the others as doubles."""
    return df.selectExpr(*names_sql(keep), *[f"CAST({c} AS DOUBLE) AS {c}" for c in names_sql(columns)])


def with_expressions(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Replace or add columns given as SQL text; the other columns stay as they are."""
    have = df.columns
    return df.selectExpr(
        *[f"{expressions[c]} AS {name_sql(c)}" if c in expressions else name_sql(c) for c in have],
        *[f"{e} AS {name_sql(c)}" for c, e in expressions.items() if c not in have],
    )


def long_cells(df: DataFrame, columns: Iterable[str], value: str = "value", cast: str | None = None) -> DataFrame:
    """feature and value of every cell of the named columns."""
    names = names_sql(columns)
    narrow = df.selectExpr(*[f"CAST({c} AS {cast}) AS {c}" if cast else c for c in names])
    return narrow.unpivot([], names, "feature", value)
