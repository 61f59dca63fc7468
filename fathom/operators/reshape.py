"""Long to wide, wide to long, union by name, nested rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import name_sql, names_sql, quoted, text_literal

# A wide table with more columns than this is refused rather than planned.
MAX_WIDE_COLUMNS = 20000


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Union by column name; a column that one table lacks is missing in its rows."""
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t, allowMissingColumns=True)
    return result


def distinct_names(df: DataFrame, column: str, limit: int = MAX_WIDE_COLUMNS) -> list[str]:
    """The distinct names that become columns, sorted; refuses more than ``limit``."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values")
    return sorted(found)


def widen(
    df: DataFrame,
    names_from: str,
    values_from: str,
    names: Sequence[str] | None = None,
    fill: float | None = None,
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """One column per name; all other columns identify the row.

    ``fill`` goes into cells that no input row describes, not into cells whose value is missing.
    A cell described by two different values is an error.
    """
    ids = list(ids) if ids is not None else [c for c in df.columns if c not in (names_from, values_from)]
    names = list(names) if names is not None else distinct_names(df, names_from)
    if set(names) & set(ids):
        raise ValueError(f"names already in use: {sorted(set(names) & set(ids))}")
    value = quoted(values_from)
    wide = (
        df.groupBy(*names_sql(ids))
        .pivot(names_from, names)
        .agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    )

    def cell(name: str) -> str:
        low, high, n = (name_sql(f"{name}_{part}") for part in ("low", "high", "n"))
        clash = f"raise_error({text_literal('more than one value for ' + name)})"
        single = f"CASE WHEN {low} = {high} OR {low} IS NULL THEN {high} ELSE {clash} END"
        if fill is not None:
            single = f"CASE WHEN {n} IS NULL THEN {fill} ELSE {single} END"
        return f"{single} AS {name_sql(name)}"

    return wide.selectExpr(*names_sql(ids), *[cell(n) for n in names])


def lengthen(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    name: str = "name",
    value: str = "value",
    ids: Sequence[str] | None = None,
    cast: str | None = None,
) -> DataFrame:
    """One row per (row, column). Without ``columns`` every column but ``ids`` is taken."""
    if columns is None:
        columns = [c for c in df.columns if c not in (ids or ())]
    if ids is None:
        ids = [c for c in df.columns if c not in columns]
    if cast:
        df = df.selectExpr(*names_sql(ids), *[f"CAST({c} AS {cast}) AS {c}" for c in names_sql(columns)])
    return df.unpivot(names_sql(ids), names_sql(columns), name, value)


def one_wide_row(df: DataFrame, column: str, limit: int = 1000, prefix: str = "V") -> DataFrame:
    """The distinct values of a column as one row of columns V1, V2, .. in value order."""
    values = distinct_names(df, column, limit)
    if not values:
        raise ValueError(f"{column} holds no value")
    schema = T.StructType([T.StructField(f"{prefix}{i + 1}", T.StringType()) for i in range(len(values))])
    return df.sparkSession.createDataFrame([tuple(str(v) for v in values)], schema)


def nest(df: DataFrame, groups: Sequence[str], name: str = "data") -> DataFrame:
    """One row per group with the other columns as an array of rows. For small groups only."""
    others = [c for c in df.columns if c not in groups]
    return df.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct(*others))).alias(name))


def unnest(df: DataFrame, name: str = "data") -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], F.inline(F.col(name)))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``names`` maps old to new."""
    return df.withColumnsRenamed(dict(names))
