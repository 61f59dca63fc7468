"""Model explanation as batch jobs: one ``transform`` over replicated rows per question.

Rows are multiplied by ``explode`` inside the scan, scored, and aggregated map-side, so only
group means are shuffled. Binary classifiers are explained by the probability of one class.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import long_cells, quoted
from ..session import materialise
from .chartdata import bin_index, box_statistics, value_bounds
from .ordering import HASH_FACTOR, exact_quantiles, hashed_rank

MAX_OBSERVATIONS = 100


def explained(model: Transformer, df: DataFrame, outcome: str, key: str, features: Sequence[str], output: str = "predict") -> DataFrame:
    """key, features, truth, prediction and residual."""
    truth = quoted(outcome).cast("double")
    return model.transform(df).select(
        key, *[quoted(c) for c in features], truth.alias("truth"), quoted(output).cast("double").alias("prediction"),
        (truth - quoted(output).cast("double")).alias("residual"),
    )


def _scored(model: Transformer, df: DataFrame, output: str) -> DataFrame:
    return model.transform(df).withColumn("_y", quoted(output).cast("double"))


def _doubles(df: DataFrame, features: Sequence[str]) -> list[Column]:
    return [quoted(c).cast("double").alias(c) for c in features]


def permutation_importance(
    model: Transformer, df: DataFrame, features: Sequence[str], outcome: str, key: str, repeats: int = 10,
    output: str = "predict", seed: int = 1, method: str = "xxhash64",
) -> DataFrame:
    """feature, repeat, loss (root mean square error) and its rise over the loss on the data as it is.

    Rows are put in hash order once. In repeat r every row takes a feature's value from the row that stands
    ``shift_of(r, rows)`` places on, in a circle, so all repeats and features share one join.
    """
    rows = df.where(quoted(outcome).isNotNull()).select(key, quoted(outcome).cast("double").alias("_truth"), *_doubles(df, features))
    ranked = materialise(hashed_rank(rows, key, seed=seed, method=method, name="_place"), "places")
    n = ranked.count()
    gap = F.col("_truth") - F.col("_y")
    loss = F.sqrt(F.avg(gap * gap))
    base = _scored(model, ranked, output).agg(loss.alias("loss")).first().loss
    shifts = F.array(*[F.struct(F.lit(r).alias("_repeat"), F.lit(shift_of(r, n)).alias("_shift")) for r in range(1, repeats + 1)])
    several = ranked.select("*", F.inline(shifts)).withColumn("_from", (F.col("_place") - 1 + F.col("_shift")) % F.lit(max(n, 1)) + 1)
    donors = ranked.select(F.col("_place").alias("_from"), F.struct(*[quoted(c) for c in features]).alias("_donor"))
    replaced = several.join(donors, "_from").withColumn("_feature", F.explode(F.array(*[F.lit(c) for c in features]))).select(
        "_repeat", "_feature", "_truth",
        *[F.when(F.col("_feature") == c, F.col("_donor")[c]).otherwise(quoted(c)).alias(c) for c in features],
    )
    losses = _scored(model, replaced, output).groupBy("_repeat", "_feature").agg(loss.alias("loss"))
    return losses.select(
        F.col("_feature").alias("feature"), F.col("_repeat").alias("repeat"), "loss", (F.col("loss") - F.lit(base)).alias("rise")
    )


def shift_of(repeat: int, rows: int) -> int:
    """How many places the values of a repeat come from: spread over the circle, never none if there are other rows."""
    return 1 + repeat * HASH_FACTOR % (rows - 1) if rows > 1 else 0


def importance_summary(importance: DataFrame) -> DataFrame:
    return importance.groupBy("feature").agg(
        F.avg("rise").alias("importance"), F.min("rise").alias("lowest"), F.max("rise").alias("highest")
    )


def quantile_grids(df: DataFrame, features: Sequence[str], points: int = 11) -> dict[str, list[float]]:
    """A few increasing values per feature: the distinct quantiles at even shares of its rows."""
    shares = {f"q{i}": i / (points - 1) for i in range(points)}
    found = exact_quantiles(long_cells(df, features, "value", cast="double"), ["feature"], "value", shares)
    rows = {r["feature"]: r for r in found.collect()}
    return {c: sorted({rows[c][q] for q in shares}) if c in rows else [] for c in features}


def _grid_cells(grids: dict[str, list[float]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(i).alias("point"), F.lit(float(v)).alias("x"))
            for c, values in grids.items()
            for i, v in enumerate(values)
        ]
    )


def _with_grid(df: DataFrame, features: Sequence[str], grids: dict[str, list[float]], keep: Sequence[str] = ()) -> DataFrame:
    cells = df.select(*[quoted(c) for c in keep], *_doubles(df, features)).withColumn("_cell", F.explode(_grid_cells(grids)))
    return cells.select(
        *[quoted(c) for c in keep], "_cell",
        *[F.when(F.col("_cell.feature") == c, F.col("_cell.x")).otherwise(quoted(c)).alias(c) for c in features],
    )


def partial_dependence(
    model: Transformer, df: DataFrame, features: Sequence[str], points: int = 11, output: str = "predict"
) -> DataFrame:
    """feature, x, mean prediction with the feature set to x in every row."""
    grids = quantile_grids(df, features, points)
    scored = _scored(model, _with_grid(df, features, grids), output)
    return scored.groupBy(F.col("_cell.feature").alias("feature"), F.col("_cell.x").alias("x")).agg(F.avg("_y").alias("mean"))


def row_profiles(
    model: Transformer, df: DataFrame, observations: DataFrame, features: Sequence[str], key: str, points: int = 11,
    output: str = "predict",
) -> DataFrame:
    """key, feature, x, prediction for each observation with one feature moved along its grid."""
    grids = quantile_grids(df, features, points)
    scored = _scored(model, _with_grid(observations, features, grids, [key]), output)
    return scored.select(key, F.col("_cell.feature").alias("feature"), F.col("_cell.x").alias("x"), F.col("_y").alias("prediction"))


def accumulated_dependence(
    model: Transformer, df: DataFrame, features: Sequence[str], points: int = 11, output: str = "predict"
) -> DataFrame:
    """feature, x, accumulated local effect: summed mean steps between grid points, centred.

    Each row contributes two predictions per feature, at the two ends of its own grid interval.
    """
    grids = {c: g for c, g in quantile_grids(df, features, points).items() if len(g) > 1}
    interval = {}
    for c, g in grids.items():
        place = F.lit(len(g) - 1)
        for i in range(len(g) - 2, 0, -1):
            place = F.when(quoted(c) <= F.lit(float(g[i])), F.lit(i)).otherwise(place)
        interval[c] = F.when(quoted(c).isNotNull(), place)
    steps = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), interval[c].alias("interval"), F.lit(end).alias("end"),
                F.element_at(F.array(*[F.lit(float(v)) for v in grids[c]]), F.coalesce(interval[c], F.lit(1)) + (0 if end == 0 else 1)).alias("x"),
            )
            for c in grids
            for end in (0, 1)
        ]
    )
    cells = df.select(*_doubles(df, features)).withColumn("_cell", F.explode(steps)).where(F.col("_cell.interval").isNotNull())
    moved = cells.select(
        "_cell", *[F.when(F.col("_cell.feature") == c, F.col("_cell.x")).otherwise(quoted(c)).alias(c) for c in features]
    )
    sign = F.when(F.col("_cell.end") == 1, F.col("_y")).otherwise(-F.col("_y"))
    effects = _scored(model, moved, output).groupBy(
        F.col("_cell.feature").alias("feature"), F.col("_cell.interval").alias("interval")
    ).agg((F.sum(sign) * 2 / F.count(F.lit(1))).alias("step"), (F.count(F.lit(1)) / 2).alias("rows")).collect()
    found = {(r.feature, r.interval): (r.step, r.rows) for r in effects}
    result = []
    for c, g in grids.items():
        level, levels, weight, middle = 0.0, [0.0], 0.0, 0.0
        for i in range(1, len(g)):
            step, n = found.get((c, i), (0.0, 0.0))
            middle += n * (level + step / 2)
            level += step
            weight += n
            levels.append(level)
        centre = middle / weight if weight else 0.0
        result += [(c, float(x), v - centre) for x, v in zip(g, levels)]
    return df.sparkSession.createDataFrame(result, "feature string, x double, effect double")


def _picked(observations: DataFrame, key: str, features: Sequence[str]) -> list:
    rows = observations.select(quoted(key).cast("string").alias("_key"), *_doubles(observations, features)).limit(MAX_OBSERVATIONS + 1).collect()
    if len(rows) > MAX_OBSERVATIONS:
        raise ValueError(f"explain at most {MAX_OBSERVATIONS} observations at a time")
    return sorted(rows, key=lambda r: r["_key"])


def contributions(
    model: Transformer, background: DataFrame, observations: DataFrame, features: Sequence[str], key: str,
    orderings: Sequence[Sequence[str]], output: str = "predict",
) -> DataFrame:
    """key, ordering, feature, contribution: change of the mean prediction over the background when
    the observation's values are fixed one after the other.

    Contributions of one ordering add up to the observation's prediction minus the mean prediction.
    Orderings share their sets of fixed features: an observation is scored once with each set.
    """
    schema = f"`{key}` string, ordering int, feature string, contribution double"
    picked = _picked(observations, key, features)
    if not picked:
        return background.sparkSession.createDataFrame([], schema)
    # Every set of fixed features that some ordering passes through, each once; the first is the empty set.
    places = {c: k for k, c in enumerate(features)}
    passed = [[sum(1 << places[c] for c in order[:j]) for j in range(len(order) + 1)] for order in orderings]
    masks = list(dict.fromkeys([0, *[m for row in passed for m in row]]))
    index = {m: k for k, m in enumerate(masks)}
    fixed_sets = len(masks) - 1
    # With nothing fixed all observations are alike, so that set is scored once for all of them.
    size = 1 + len(picked) * fixed_sets
    entry = F.col("_i") - 1
    mask = F.when(F.col("_i") == 0, 0).otherwise(1 + entry % F.lit(max(fixed_sets, 1))).cast("int")
    who = F.when(F.col("_i") == 0, 0).otherwise(F.floor(entry / F.lit(max(fixed_sets, 1)))).cast("int")
    rows = background.select(*_doubles(background, features)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))

    def fixed(c: str) -> Column:
        inside = F.array(*[F.lit(bool(m >> places[c] & 1)) for m in masks])
        values = F.array(*[F.lit(None if r[c] is None else float(r[c])).cast("double") for r in picked])
        return F.when(F.get(inside, mask), F.get(values, who)).otherwise(quoted(c)).alias(c)

    scored = _scored(model, rows.select("_i", *[fixed(c) for c in features]), output)
    means = {r["_i"]: r.m for r in scored.groupBy("_i").agg(F.avg("_y").alias("m")).collect()}
    mean = lambda a, m: means[1 + a * fixed_sets + index[m] - 1 if m else 0]
    result = []
    for a, row in enumerate(picked):
        for b, order in enumerate(orderings):
            result.append((row["_key"], b, "(mean)", mean(a, 0)))
            result += [(row["_key"], b, c, mean(a, passed[b][j + 1]) - mean(a, passed[b][j])) for j, c in enumerate(order)]
    return background.sparkSession.createDataFrame(result, schema)


def break_down(
    model: Transformer, background: DataFrame, observations: DataFrame, features: Sequence[str], key: str, output: str = "predict"
) -> DataFrame:
    """Contributions in the given feature order."""
    return contributions(model, background, observations, features, key, [list(features)], output).drop("ordering")


def shapley(
    model: Transformer, background: DataFrame, observations: DataFrame, features: Sequence[str], key: str, samples: int = 10,
    output: str = "predict", seed: int = 1,
) -> DataFrame:
    """Contributions averaged over sampled feature orders."""
    draw = random.Random(seed)
    orders = [draw.sample(list(features), len(features)) for _ in range(samples)]
    table = contributions(model, background, observations, features, key, orders, output)
    return table.groupBy(key, "feature").agg(F.avg("contribution").alias("contribution"), F.stddev_samp("contribution").alias("spread"))


def residuals_by_feature(scored: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """feature, bin, part (truth or residual) and box statistics, from the output of ``explained``."""
    bounds = value_bounds(scored, features)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), bin_index(quoted(c), bounds[c], bins).alias("bin"),
                F.lit(part).alias("part"), F.col(part).alias("value"),
            )
            for c in features
            for part in ("truth", "residual")
        ]
    )
    long = scored.select(F.inline(cells)).where(F.col("bin").isNotNull())
    return box_statistics(long, ["feature", "bin", "part"], "value")
