"""The tables behind charts: histograms, shares, densities, box statistics, hexagonal bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import long_cells, names_sql, numeric_columns, quoted, text_columns
from ..functions.numbers import exact_avg
from .ordering import exact_quantiles, running_totals
from .rank import share_within

# numeric constants of the normal reference bandwidth: fixed values
BANDWIDTH_FACTOR = 0.9
IQR_PER_SD = 1.34
#: Bandwidths beyond which a Gaussian is below double precision.
KERNEL_REACH = 9.0


def value_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    """Smallest and largest value of each column, read in one pass; ``None`` if all are missing."""
    names = names_sql(columns)
    row = df.selectExpr(
        *[f"CAST(min({c}) AS DOUBLE) AS low{i}" for i, c in enumerate(names)],
        *[f"CAST(max({c}) AS DOUBLE) AS high{i}" for i, c in enumerate(names)],
    ).first()
    return {
        c: None if row[f"low{i}"] is None else (row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(columns)
    }


def bin_index(value: Column, bounds: tuple[float, float] | None, bins: int) -> Column:
    """0-based equal-width bin of [low, high]; the last bin includes the upper end."""
    if bounds is None:
        return F.lit(None).cast("int")
    low, high = bounds
    if low == high:
        return F.when(value.isNotNull(), F.lit(0))
    place = F.floor((value.cast("double") - F.lit(low)) / F.lit(high - low) * F.lit(float(bins)))
    return F.when(value.isNotNull(), F.least(place.cast("int"), F.lit(bins - 1)))


def histograms(df: DataFrame, bins: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, bin, n: one histogram per column over its own range, text columns as codes."""
    columns = list(columns) if columns is not None else df.columns
    numeric = [c for c in numeric_columns(df) if c in columns]
    text = [c for c in text_columns(df) if c in columns]
    parts = []
    if numeric:
        bounds = value_bounds(df, numeric)
        binned = df.select(*[bin_index(quoted(c), bounds[c], bins).alias(c) for c in numeric])
        cells = binned.unpivot([], names_sql(numeric), "feature", "bin")
        parts.append(cells.where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")))
    if text:
        cells = long_cells(df, text)
        counts = cells.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        coded = running_totals(counts.withColumn("_one", F.lit(1).cast("long")), ["feature"], "value", ["_one"])
        place = F.floor(
            F.try_divide((F.col("cum__one") - 1).cast("double"), F.col("all__one") - 1) * F.lit(float(bins))
        )
        index = F.when(F.col("all__one") > 1, F.least(place.cast("int"), F.lit(bins - 1))).otherwise(F.lit(0))
        parts.append(coded.select("feature", index.alias("bin"), "n").groupBy("feature", "bin").agg(F.sum("n").alias("n")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def category_histogram(df: DataFrame, value: str, category: str, bins: int = 30) -> DataFrame:
    """category, bin, n over one shared range, for stacked bars."""
    bounds = value_bounds(df, [value])[value]
    return (
        df.select(category, bin_index(F.col(value), bounds, bins).alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy(category, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def proportion_bars(df: DataFrame, category: str, columns: Sequence[str]) -> DataFrame:
    """name, value, category, n, share: shares of the category for each value of each column."""
    cells = df.select(category, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [category], list(columns), "name", "value"
    )
    return share_within(cells, ["name", "value"], category, share="share", scale=1.0)


def category_totals(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def group_percentage(df: DataFrame, group: str, value: str) -> DataFrame:
    """100 times the sum over the number of rows, missing values counted among the rows."""
    total = F.sum(F.col(value).cast("decimal(38,12)")).cast("double")
    return df.groupBy(group).agg((total * 100 / F.count(F.lit(1))).alias("percentage"))


def density(df: DataFrame, facet: str, group: str, value: str, points: int = 512) -> DataFrame:
    """Gaussian kernel density per (facet, group) on ``points`` grid points over the facet's range.

    Every value is shared out to its two neighbouring grid points first, so the kernel is summed
    over at most ``points`` weights per group however many rows there are.
    Groups of fewer than two values are left out.
    """
    keys = [facet, group]
    known = df.select(facet, group, F.col(value).cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & F.col(facet).isNotNull() & F.col(group).isNotNull()
    )
    spread = known.groupBy(*keys).agg(F.stddev_samp("_x").alias("_sd"), F.max(F.abs("_x")).alias("_any"))
    quartiles = exact_quantiles(known, keys, "_x", {"_q1": 0.25, "_q3": 0.75}).where(F.col("n") > 1)
    narrow = F.least("_sd", (F.col("_q3") - F.col("_q1")) / IQR_PER_SD)
    width = F.when(narrow > 0, narrow).when(F.col("_sd") > 0, F.col("_sd")).when(F.col("_any") > 0, F.col("_any")).otherwise(1.0)
    groups = quartiles.join(spread, keys).select(
        *keys, "n", (F.lit(BANDWIDTH_FACTOR) * width * F.pow("n", F.lit(-0.2))).alias("bandwidth"), "low", "high"
    )
    range_of = groups.groupBy(facet).agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    settings = groups.drop("low", "high").join(range_of, facet).withColumn(
        "_step", (F.col("_high") - F.col("_low")) / F.lit(float(points - 1))
    )
    cells = _shared_out(known.join(range_of, facet), points).groupBy(*keys, "_cell").agg(F.sum("_w").alias("_w"))
    # A weight meets the grid points that its kernel reaches, and no others.
    reach = F.ceil(F.lit(KERNEL_REACH) * F.col("bandwidth") / F.nullif(F.col("_step"), F.lit(0.0)))
    wide = F.coalesce(F.least(reach, F.lit(points)), F.lit(points)).cast("int")
    near = F.sequence(F.greatest(F.col("_cell") - wide, F.lit(0)), F.least(F.col("_cell") + wide, F.lit(points - 1)))
    met = cells.join(settings, keys).withColumn("_point", F.explode(near))
    gap = (F.col("_point") - F.col("_cell")) * F.col("_step") / F.col("bandwidth")
    sums = met.groupBy(*keys, "_point").agg(F.sum(F.col("_w") * F.exp(-gap * gap / 2.0)).alias("_sum"))
    named = sums.withColumnsRenamed({c: f"_at_{c}" for c in (*keys, "_point")})
    grid = settings.withColumn("_point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    same = [F.col(c) == F.col(f"_at_{c}") for c in (*keys, "_point")]
    return grid.join(named, same, "left").select(
        *keys,
        F.col("_point").alias("point"),
        (F.col("_low") + F.col("_point") * F.col("_step")).alias("x"),
        (F.coalesce("_sum", F.lit(0.0)) / (F.col("n") * F.col("bandwidth") * F.lit(math.sqrt(2 * math.pi)))).alias("density"),
    )


def _shared_out(df: DataFrame, points: int) -> DataFrame:
    """Two weighted rows per value: its lower and upper neighbour on the grid of its facet."""
    place = F.coalesce(
        F.try_divide((F.col("_x") - F.col("_low")) * F.lit(float(points - 1)), F.col("_high") - F.col("_low")),
        F.lit(0.0),
    )
    cell = F.least(F.floor(place).cast("int"), F.lit(points - 2))
    rest = place - cell
    both = F.array(
        F.struct(cell.alias("_cell"), (1.0 - rest).alias("_w")), F.struct((cell + 1).alias("_cell"), rest.alias("_w"))
    )
    return df.select("*", F.inline(both))


def box_statistics(df: DataFrame, groups: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (values within ``reach`` IQR of the hinges), and outlier counts."""
    known = df.select(*groups, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    hinges = exact_quantiles(known, groups, "_x", {"lower": 0.25, "median": 0.5, "upper": 0.75})
    hinges = hinges.select(*[F.col(g).alias(f"_key_{g}") for g in groups], "n", "lower", "median", "upper")
    values = known.groupBy(*groups, "_x").agg(F.count(F.lit(1)).alias("_n"))
    condition = F.lit(True)
    for g in groups:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_key_{g}"))
    joined = values.join(hinges, condition)
    iqr = F.col("upper") - F.col("lower")
    inside = F.col("_x").between(F.col("lower") - reach * iqr, F.col("upper") + reach * iqr)
    return joined.groupBy(*groups, "n", "lower", "median", "upper").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_n"))).cast("long").alias("outliers"),
    )


def hexagon_means(df: DataFrame, x: str, y: str, z: str, bins: int = 35, scale: int = 8) -> DataFrame:
    """Mean of ``z`` per hexagon, the x and y ranges being cut into ``bins`` widths.

    Hexagon centres form two offset rectangular lattices; a point belongs to the nearer centre.
    """
    bounds = value_bounds(df, [x, y])
    if bounds[x] is None or bounds[y] is None:
        raise ValueError("no known coordinates")

    def scaled(name: str) -> Column:
        low, high = bounds[name]
        width = (high - low) / bins if high > low else 1.0
        return (F.col(name).cast("double") - F.lit(low)) / F.lit(width)

    # Rows of hexagons are sqrt(3) widths apart within one lattice.
    root = math.sqrt(3.0)
    u, v = scaled(x), scaled(y) / F.lit(root)
    near_u, near_v = F.floor(u + 0.5), F.floor(v + 0.5)
    off_u, off_v = F.floor(u) + 0.5, F.floor(v) + 0.5
    squared = lambda a, b: (u - a) * (u - a) + (v - b) * (v - b) * 3.0
    first = squared(near_u, near_v) <= squared(off_u, off_v)
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(
            F.when(first, near_u).otherwise(off_u).cast("double").alias("hex_x"),
            F.when(first, near_v).otherwise(off_v).cast("double").alias("hex_y"),
            F.col(z).cast("double").alias("_z"),
        )
        .groupBy("hex_x", "hex_y")
        .agg(exact_avg("_z", scale).alias("mean"), F.count("_z").alias("n"))
    )
