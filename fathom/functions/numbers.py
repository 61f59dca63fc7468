"""Numeric expressions whose NULL, zero and rounding behaviour is fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """Round with halves going up; values too large to have such digits are returned as they are."""
    c = as_column(c).cast("double")
    scale = float(10**digits)
    return F.when(F.abs(c) < 1e15 / scale, F.floor(c * scale + 0.5) / F.lit(scale)).otherwise(c)


def number_text(c: Column | str, digits: int) -> Column:
    """A number as text without a trailing ``.0``: 12, 12.5, 0.04."""
    text = round_half_up(c, digits).cast(f"decimal(18,{digits})").cast("string")
    return text if digits == 0 else F.regexp_replace(text, r"\.?0+$", "")


def percent_text(c: Column | str, digits: int = 2) -> Column:
    return number_text(as_column(c) * 100, digits)


def nan_to_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def clamp_negative(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def sign_label(c: Column | str) -> Column:
    return F.when(as_column(c) >= 0, "Positive").otherwise("Negative")


def exact_sum(c: Column | str, scale: int = 8) -> Column:
    """Sum that does not depend on row order: added as decimals, returned as double."""
    return F.sum(as_column(c).cast(f"decimal({18 + scale - 4},{scale})")).cast("double")


def exact_avg(c: Column | str, scale: int = 8) -> Column:
    c = as_column(c)
    return F.try_divide(exact_sum(c, scale), F.count(c))


def few_avg(c: Column | str) -> Column:
    """Average of a few values, added in ascending order: the same doubles in whatever order rows come.

    It collects its values, so it is for groups of bounded size.
    """
    c = as_column(c)
    total = F.aggregate(F.sort_array(F.collect_list(c)), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.count(c))


def na_propagating(aggregate: Column, c: Column | str, na_propagate: bool = False) -> Column:
    """An aggregate that is NULL as soon as one input is NULL, when asked for."""
    if not na_propagate:
        return aggregate
    return F.when(F.count_if(as_column(c).isNull()) == 0, aggregate)


def count_distinct_na(c: Column | str) -> Column:
    """Distinct count in which a missing value counts as one more value; 0 on empty input."""
    c = as_column(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))


def correlation_sql(x: str, y: str) -> str:
    """Pairwise-complete Pearson correlation of two SQL expressions; NULL where a side is constant."""
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    px = f"CASE WHEN {both} THEN CAST({x} AS DOUBLE) END"
    py = f"CASE WHEN {both} THEN CAST({y} AS DOUBLE) END"
    return f"try_divide(covar_pop({px}, {py}), stddev_pop({px}) * stddev_pop({py}))"


def skewness_sql(c: str, na_propagate: bool = False) -> str:
    """Population skewness of an SQL expression; NULL where all values are equal."""
    value = f"CASE WHEN max({c}) > min({c}) THEN skewness({c}) END"
    return f"CASE WHEN count_if({c} IS NULL) = 0 THEN {value} END" if na_propagate else value
