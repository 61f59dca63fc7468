"""Group maxima, top-n with ties, shares and category order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import exact_quantiles, running_totals

# Spark cuts each map task's groups to the first n rows before the shuffle only up to this n.
GROUP_LIMIT_THRESHOLD = 1000


def top_n_with_ties(df: DataFrame, groups: Sequence[str], column: str, n: int) -> DataFrame:
    """The rows of each group whose value is among the n largest, all ties of the last one kept.

    Missing values come last. Small n: every map task keeps only its own best rows before the
    shuffle, so a large group does not travel whole. Large n: values are counted first and ranked
    in ranges, and the rows are picked by a semi join on (group, value).
    """
    if n <= GROUP_LIMIT_THRESHOLD:
        order = Window.partitionBy(*groups).orderBy(F.col(column).desc_nulls_last())
        return df.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= n).drop("_rank")
    counts = df.groupBy(*groups, column).agg(F.count(F.lit(1)).alias("_n"))
    known = counts.where(F.col(column).isNotNull())
    ranked = running_totals(known, groups, column, ["_n"], descending=True)
    keep = ranked.where(F.col("cum__n") - F.col("_n") < n).select(*groups, column)
    sizes = known.groupBy(*groups).agg(F.sum("_n").alias("_known"))
    missing = counts.where(F.col(column).isNull()).select(*groups, column)
    open_groups = missing.join(sizes, [missing[g].eqNullSafe(sizes[g]) for g in groups], "left")
    keep = keep.unionByName(
        open_groups.where(F.coalesce(F.col("_known"), F.lit(0)) < n).select(
            *[missing[g] for g in groups], missing[column]
        )
    ).withColumnsRenamed({c: f"_keep_{c}" for c in (*groups, column)})
    return df.join(keep, [df[c].eqNullSafe(keep[f"_keep_{c}"]) for c in (*groups, column)], "left_semi")


def group_maximum(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """The rows that hold their group's largest value, ties kept; missing values never do."""
    return top_n_with_ties(df.where(F.col(column).isNotNull()), groups, column, 1)


def first_of_ties(df: DataFrame, column: str, by: str) -> DataFrame:
    """One row per value of ``column``: the one that comes first by ``by``."""
    order = Window.partitionBy(column).orderBy(by)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def share_within(
    df: DataFrame, groups: Sequence[str], category: str, count: str = "n", share: str = "percent", scale: float = 100.0
) -> DataFrame:
    """Rows per (group, category) and their share of the group; the window sees counts only."""
    counts = df.groupBy(*groups, category).agg(F.count(F.lit(1)).alias(count))
    whole = Window.partitionBy(*groups)
    return counts.withColumn(share, F.col(count) / F.sum(count).over(whole) * F.lit(scale))


def category_order(df: DataFrame, category: str, by: str, descending: bool = False) -> DataFrame:
    """Categories with the median of another column and their 1-based position by it (ties by name)."""
    medians = exact_quantiles(df, [category], by, {"median": 0.5}).select(category, "median")
    return numbered(medians, ["median", category], descending)


def appearance_order(df: DataFrame, category: str, row_key: str, descending: bool = False) -> DataFrame:
    """Categories by their first appearance, which is the smallest row key."""
    first = df.groupBy(category).agg(F.min(row_key).alias("first_key"))
    return numbered(first, ["first_key", category], descending)


def numbered(small: DataFrame, order: Sequence[str], descending: bool = False, name: str = "position") -> DataFrame:
    """Number the rows of a small table (one row per category, feature or model)."""
    columns = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order]
    return small.withColumn(name, F.row_number().over(Window.orderBy(*columns)).cast("long"))
