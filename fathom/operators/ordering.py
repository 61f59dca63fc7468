"""Running totals, ranks and exact quantiles without sorting a whole group in one task.

A group, or the whole table, is cut into ranges of the ordering value. Each range is sorted on its
own and lifted by the total of the ranges before it, so the largest sort is one range of one group
even when one group holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import as_column
from ..session import materialise

# 2**32 divided by the golden ratio, and a prime modulus: fixed values of the arithmetic hash.
HASH_FACTOR = 2654435761
HASH_MODULUS = 1000003


def range_count(df: DataFrame) -> int:
    """How many ranges to cut an ordering into: a few per shuffle task."""
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, column: str, parts: int | None = None, groups: Sequence[str] = ()) -> list:
    """At most ``parts - 1`` increasing values that cut the rows of ``df`` into similar shares.

    Taken from a fixed-size sample chosen by hash of group and value, so that values which many
    groups share don't crowd out those of a large group. Points only steer the work: any points
    give the same results.
    """
    parts = parts or range_count(df)
    wanted = parts * 20
    sample = (
        df.select(F.xxhash64(*groups, column).alias("h"), F.col(column).alias("v"))
        .where(F.col("v").isNotNull())
        .orderBy("h")
        .limit(wanted)
        .collect()
    )
    values = sorted(r.v for r in sample)
    step = max(1, len(values) // parts)
    return sorted(set(values[step::step]))


def range_index(value: Column | str, points: Sequence) -> Column:
    """Number of points that are not above ``value``, by binary search in one expression."""
    value = as_column(value)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(points[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(points))


def _lifted(
    df: DataFrame, groups: Sequence[str], order: Column, sums: Sequence[str]
) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Join each (group, ``_range``) to the totals of the ranges before it and of the whole group."""
    per_range = df.groupBy(*groups, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    earlier = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = per_range.select(
        *[F.col(g).alias(f"_key_{g}") for g in groups],
        F.col("_range").alias("_key_range"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"_total_{c}") for c in sums],
    )
    condition = F.col("_range") == F.col("_key_range")
    for g in groups:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_key_{g}"))
    joined = df.join(offsets, condition).drop("_key_range", *[f"_key_{g}" for g in groups])
    return (
        joined,
        {c: F.col(f"_before_{c}") for c in sums},
        {c: F.col(f"_total_{c}") for c in sums},
    )


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<c>`` (running total up to and with this row) and ``all_<c>`` (group total).

    ``df`` must hold one row per (group, order value), and no NULL in ``order``. It is written out
    once, so that split points, range totals and rows all come from the same values.
    """
    df = materialise(df, "ordered")
    points = split_points(df, order, groups=groups)
    cut = df.withColumn("_range", range_index(order, points))
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    joined, before, total = _lifted(cut, groups, turn("_range"), sums)
    within = (
        Window.partitionBy(*groups, "_range")
        .orderBy(turn(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.select(
        *df.columns,
        *[(before[c] + F.sum(c).over(within)).alias(f"cum_{c}") for c in sums],
        *[total[c].alias(f"all_{c}") for c in sums],
    )


def hash_value(key: Column | str, seed: int = 0, method: str = "xxhash64") -> Column:
    """A seeded number in [0, HASH_MODULUS) that depends on the key alone, not on partitioning."""
    key = as_column(key)
    if method == "arithmetic":
        return (key % HASH_MODULUS * (HASH_FACTOR % HASH_MODULUS) + seed) % HASH_MODULUS
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(HASH_MODULUS))


def hashed_rank(
    df: DataFrame,
    key: str,
    groups: Sequence[str] = (),
    seed: int = 0,
    method: str = "xxhash64",
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in hash order (ties by key), and optionally add its size.

    The hash is uniform, so equal ranges of it hold equal shares of even the largest group.
    """
    parts = range_count(df)
    hashed = df.withColumn("_hash", hash_value(key, seed, method)).withColumn("_one", F.lit(1).cast("long"))
    cut = hashed.withColumn("_range", F.floor(F.col("_hash") * parts / HASH_MODULUS).cast("int"))
    joined, before, all_rows = _lifted(cut, groups, F.col("_range").asc(), ["_one"])
    within = Window.partitionBy(*groups, "_range").orderBy("_hash", key)
    columns = [*df.columns, (before["_one"] + F.row_number().over(within)).alias(name)]
    if total:
        columns.append(all_rows["_one"].alias(total))
    return joined.select(*columns)


def dense_codes(values: DataFrame, groups: Sequence[str], column: str, name: str = "code") -> DataFrame:
    """1-based position of each distinct non-missing value within its group, in ascending order."""
    distinct = values.where(F.col(column).isNotNull()).select(*groups, column).distinct()
    counted = distinct.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(counted, groups, column, ["_one"]).select(
        *groups, column, F.col("cum__one").alias(name)
    )


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], column: str, probabilities: dict[str, float]
) -> DataFrame:
    """One row per group: quantiles by linear interpolation, named by ``probabilities``, and the
    count, distinct count, smallest and largest of the non-missing values."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*groups, column)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, groups, column, ["_n"])

    def value_at(position: Column) -> Column:
        holds = (F.col("cum__n") - F.col("_n") <= position) & (position < F.col("cum__n"))
        return F.max(F.when(holds, F.col(column)))

    result = []
    for name, p in probabilities.items():
        place = (F.col("all__n") - 1) * F.lit(float(p))
        result += [
            value_at(F.floor(place)).alias(f"_low_{name}"),
            value_at(F.ceil(place)).alias(f"_high_{name}"),
            F.max(place - F.floor(place)).alias(f"_part_{name}"),
        ]
    low_high = ranked.groupBy(*groups).agg(
        F.max("all__n").alias("n"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
        *result,
    )
    return low_high.select(
        *groups,
        "n",
        "n_distinct",
        "low",
        "high",
        *[
            (
                F.col(f"_low_{n}") + F.col(f"_part_{n}") * (F.col(f"_high_{n}") - F.col(f"_low_{n}"))
            ).alias(n)
            for n in probabilities
        ],
    )
