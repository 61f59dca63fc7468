"""Left joins of the shapes the collation needs, safe for keys that hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _condition(left: DataFrame, right: DataFrame, keys: Mapping[str, str], null_safe: bool):
    result = None
    for l, r in keys.items():
        part = left[l].eqNullSafe(right[r]) if null_safe else left[l] == right[r]
        result = part if result is None else result & part
    return result


def _renamed(left: DataFrame, right: DataFrame, keys: Mapping[str, str], suffix: str) -> tuple[DataFrame, dict]:
    """Give every right column a name that the left side does not use."""
    taken = set(left.columns)
    names = {}
    for c in right.columns:
        if c in keys.values():
            names[c] = f"_right_{c}"
        elif c in taken:
            names[c] = f"{c}{suffix}"
    return right.withColumnsRenamed(names), {l: names[r] for l, r in keys.items()}


def left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, str] | Sequence[str],
    null_safe: bool = False,
    suffix: str = "_right",
) -> DataFrame:
    """Left outer join on differently or equally named keys; clashing right columns get ``suffix``.

    For a right side with few rows per key. ``null_safe`` lets missing keys match each other.
    """
    keys = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    right, renamed = _renamed(left, right, keys, suffix)
    joined = left.join(right, _condition(left, right, renamed, null_safe), "left")
    return joined.drop(*renamed.values())


def left_join_many(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], suffix: str = "_right"
) -> DataFrame:
    """Left outer join to a side where one key may hold a large part of all rows.

    Spark splits a skewed right side of an inner join but not of a left outer join. So matching
    rows come from an inner join, and the left rows without partner are added from an anti join
    against the distinct right keys.
    """
    right, renamed = _renamed(left, right, keys, suffix)
    drop = list(renamed.values())
    matched = left.join(right, _condition(left, right, renamed, False)).drop(*drop)
    present = right.select(*drop).distinct()
    alone = left.join(present, _condition(left, present, renamed, False), "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left join on all column names that both sides have."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the two tables share no column name")
    return left_join(left, right, common, null_safe)


def membership_table(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """How many rows of ``df`` have, or lack, a partner value in ``other``."""
    present = other.select(F.col(other_column).alias("_member")).distinct()
    flagged = df.join(present, F.col(column).eqNullSafe(F.col("_member")), "left").select(
        F.col("_member").isNotNull().alias("is_member")
    )
    return flagged.groupBy("is_member").agg(F.count(F.lit(1)).alias("n"))
