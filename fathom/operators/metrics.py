"""Model performance from scored rows: thresholds, gains, confusion, leaderboards.

All score-ordered figures come from counts per (model, score), cumulated in score ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..functions.text import first_token
from .ordering import running_totals
from .rank import numbered
from .reshape import lengthen

BINARY_METRICS = ("auc", "logloss", "aucpr", "mean_per_class_error", "rmse", "mse")
LARGER_IS_BETTER = ("auc", "aucpr", "accuracy", "r2")
PROBABILITY_FLOOR = 1e-15


def score_counts(scored: DataFrame, models: Sequence[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Per (model, score): rows, hits and misses, with totals down to that score and of the model."""
    counts = (
        scored.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*models, F.col(score).cast("double").alias("score"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((F.col(truth) == 1).cast("long")).alias("hits"),
            F.sum((F.col(truth) != 1).cast("long")).alias("misses"),
        )
    )
    return running_totals(counts, models, "score", ["n", "hits", "misses"], descending=True)


def threshold_table(scored: DataFrame, models: Sequence[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """threshold, tpr, fpr, precision, recall: predict positive from each occurring score upwards."""
    c = score_counts(scored, models, truth, score)
    tpr = F.try_divide(F.col("cum_hits").cast("double"), F.col("all_hits"))
    return c.select(
        *models,
        F.col("score").alias("threshold"),
        tpr.alias("tpr"),
        F.try_divide(F.col("cum_misses").cast("double"), F.col("all_misses")).alias("fpr"),
        F.try_divide(F.col("cum_hits").cast("double"), F.col("cum_n")).alias("precision"),
        tpr.alias("recall"),
    )


def gain_lift(
    scored: DataFrame, models: Sequence[str], groups: int = 16, truth: str = "truth", score: str = "score"
) -> DataFrame:
    """Cumulative data fraction, capture rate and lift by score group, best first; equal scores stay together."""
    c = score_counts(scored, models, truth, score)
    index = F.floor((F.col("cum_n") - F.col("n")) * groups / F.col("all_n").cast("double")).cast("int") + 1
    per_group = c.groupBy(*models, index.alias("group")).agg(
        F.max("cum_n").alias("n"), F.max("cum_hits").alias("hits"),
        F.max("all_n").alias("all_n"), F.max("all_hits").alias("all_hits"),
    )
    part = F.col("n").cast("double") / F.col("all_n")
    caught = F.try_divide(F.col("hits").cast("double"), F.col("all_hits"))
    return per_group.select(
        *models, "group",
        part.alias("cumulative_data_fraction"),
        caught.alias("cumulative_capture_rate"),
        F.try_divide(caught, part).alias("cumulative_lift"),
    )


def binary_leaderboard(scored: DataFrame, model: str = "model_id", truth: str = "truth", score: str = "score") -> DataFrame:
    """One row per model with the binary metrics; class error at the threshold of the best F1."""
    c = score_counts(scored, [model], truth, score)
    return c.groupBy(model).agg(*binary_aggregates())


def binary_aggregates() -> list[Column]:
    """The binary metrics as aggregates over the rows of ``score_counts``."""
    p = F.least(F.greatest(F.col("score"), F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    n, hits, misses = (F.col(x).cast("double") for x in ("n", "hits", "misses"))
    cum_hits, cum_misses, cum_n = (F.col(f"cum_{x}").cast("double") for x in ("hits", "misses", "n"))
    all_hits, all_misses, all_n = (F.col(f"all_{x}").cast("double") for x in ("hits", "misses", "n"))
    below = all_misses - cum_misses + misses * 0.5
    error = (
        F.try_divide(all_hits - cum_hits, all_hits) + F.try_divide(cum_misses, all_misses)
    ) / 2.0
    f1 = F.try_divide(2.0 * cum_hits, cum_n + all_hits)
    squares = F.sum(hits * (1.0 - F.col("score")) * (1.0 - F.col("score")) + misses * F.col("score") * F.col("score"))
    mse = squares / F.max(all_n)
    return [
        F.try_divide(F.sum(hits * below), F.max(all_hits) * F.max(all_misses)).alias("auc"),
        (-F.sum(hits * F.log(p) + misses * F.log(1.0 - p)) / F.max(all_n)).alias("logloss"),
        F.sum(F.try_divide(hits, all_hits) * cum_hits / cum_n).alias("aucpr"),
        F.max(F.struct(f1.alias("f1"), F.col("score"), error.alias("error")))["error"].alias("mean_per_class_error"),
        F.sqrt(mse).alias("rmse"),
        mse.alias("mse"),
    ]


def roc_auc(scored: DataFrame, models: Sequence[str], truth: str = "truth", score: str = "score") -> DataFrame:
    c = score_counts(scored, models, truth, score)
    table = c.groupBy(*models).agg(*binary_aggregates()) if models else c.agg(*binary_aggregates())
    return table.select(*models, "auc")


def multiclass_auc(df: DataFrame, truth: str, probabilities: dict[str, str], groups: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``auc``, the mean over all pairs of classes of how well their scores part them.

    ``probabilities`` maps each class to its score column. In a pair both scores count alike: that of each
    class is asked how often its own rows score above the other's, equal scores counting half. Every
    pair comes from one table of class counts per (score column, score) and its running totals. Pairs
    with a class that a group lacks are left out, and so are rows without a truth or a score.
    """
    levels = list(probabilities)
    counts = [f"n_{i}" for i in range(len(levels))]
    names = F.array(*[F.lit(v) for v in levels])
    cells = F.array(*[
        F.struct(F.lit(i).alias("own"), F.col(c).cast("double").alias("score")) for i, c in enumerate(probabilities.values())
    ])
    known = df.select(*groups, (F.array_position(names, F.col(truth)) - 1).cast("int").alias("class"), F.inline(cells))
    table = (
        known.where("class >= 0 AND score IS NOT NULL")
        .groupBy(*groups, "own", "score")
        .agg(*[F.count_if(F.col("class") == i).alias(c) for i, c in enumerate(counts)])
    )
    totals = running_totals(table, [*groups, "own"], "score", counts)
    mine = F.element_at(F.array(*counts), F.col("own") + 1).cast("double")
    below = [F.col(f"cum_{c}") - F.col(c) * 0.5 for c in counts]
    sums = totals.groupBy(*groups, "own").agg(
        F.array(*[F.sum(mine * b) for b in below]).alias("above"), F.array(*[F.max(f"all_{c}") for c in counts]).alias("sizes")
    )
    pairs = sums.select(*groups, "own", "sizes", F.posexplode("above").alias("other", "above"))
    size = lambda c: F.element_at("sizes", F.col(c) + 1)
    shares = pairs.where("own <> other").withColumn("share", F.try_divide("above", size("own") * size("other")))
    mean = F.avg("share").alias("auc")
    return shares.groupBy(*groups).agg(mean) if groups else shares.agg(mean)


def confusion(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(
    df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = (), probability: str | None = None
) -> DataFrame:
    """Long rows: accuracy, macro-averaged sensitivity and specificity, and log loss if the
    probability of the true class is given. Rows without a truth are left out; a missing group is a group."""
    df = df.where(quoted(truth).isNotNull())
    extra = [] if probability is None else [
        F.sum(-F.log(F.greatest(F.col(probability), F.lit(PROBABILITY_FLOOR)))).alias("loss")
    ]
    cells = df.groupBy(*groups, F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg(
        F.count(F.lit(1)).alias("n"), *extra
    )
    right = F.when(F.col("_t") == F.col("_p"), F.col("n")).otherwise(0)
    totals = cells.groupBy(*groups).agg(
        F.sum("n").alias("all"), F.sum(right).alias("right"), *([F.sum("loss").alias("loss")] if extra else [])
    )
    by_truth = cells.groupBy(*groups, F.col("_t").alias("level")).agg(F.sum("n").alias("positives"), F.sum(right).alias("tp"))
    by_guess = cells.groupBy(*groups, F.col("_p").alias("level")).agg(F.sum("n").alias("guessed"))
    renamed = by_guess.withColumnsRenamed({c: f"_g_{c}" for c in (*groups, "level")})
    sizes = totals.select(*[F.col(g).alias(f"_a_{g}") for g in groups], "all")
    levels = by_truth.join(
        renamed, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in (*groups, "level")], "left"
    ).join(sizes, [F.col(g).eqNullSafe(F.col(f"_a_{g}")) for g in groups]) if groups else by_truth.join(by_guess, "level", "left").withColumn("all", F.sum("positives").over(Window.partitionBy(F.lit(1))))
    false_positive = F.coalesce("guessed", F.lit(0)) - F.col("tp")
    negatives = F.col("all") - F.col("positives")
    rates = levels.groupBy(*groups).agg(
        F.avg(F.col("tp") / F.col("positives")).alias("sensitivity"),
        F.avg(F.try_divide(negatives - false_positive, negatives)).alias("specificity"),
    )
    figures = totals.select(
        *groups, (F.col("right") / F.col("all")).alias("accuracy"),
        *([(F.col("loss") / F.col("all")).alias("mn_log_loss")] if extra else []),
    )
    names = [c for c in figures.columns if c not in groups]
    long = lengthen(figures, names, "metric", "value", ids=list(groups))
    return long.unionByName(lengthen(rates, ["sensitivity", "specificity"], "metric", "value", ids=list(groups)))


def roc_curves(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """level, threshold, specificity, sensitivity: one curve per class against all others.

    ``probabilities`` maps each class to its probability column.
    """
    cells = F.array(
        *[
            F.struct(F.lit(level).alias("level"), F.col(c).cast("double").alias("score"),
                     (F.col(truth) == F.lit(level)).cast("int").alias("truth"))
            for level, c in probabilities.items()
        ]
    )
    curves = threshold_table(df.select(F.inline(cells)), ["level"])
    return curves.select("level", "threshold", (1.0 - F.col("fpr")).alias("specificity"), F.col("tpr").alias("sensitivity"))


def regression_metrics(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """rmse, mse, mae and R squared of the rows that have both values."""
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    known = df.where(t.isNotNull() & p.isNotNull())
    gap = t - p
    mse = F.avg(gap * gap)
    measures = [
        F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(F.abs(gap)).alias("mae"),
        (1.0 - F.try_divide(mse, F.var_pop(t))).alias("r2"),
    ]
    return known.groupBy(*groups).agg(*measures) if groups else known.agg(*measures)


def ordered_leaderboard(leaderboard: DataFrame, order_by: str, model: str = "model_id") -> DataFrame:
    """Number the models from the best by a metric, and add the model type."""
    if order_by not in leaderboard.columns:
        raise ValueError(f"no metric {order_by!r} to order by; the leaderboard has {', '.join(leaderboard.columns)}")
    sign = F.col(order_by) if order_by not in LARGER_IS_BETTER else -F.col(order_by)
    ranked = numbered(leaderboard.withColumn("_order", sign), ["_order", model], name="rowname").drop("_order")
    return ranked.withColumn("model_type", first_token(model))


def leaderboard_long(
    leaderboard: DataFrame, order_by: str = "auc", n_max: int = 20, metrics: Sequence[str] | None = None,
    model: str = "model_id",
) -> DataFrame:
    """The best models in long form: rowname, model_id with its position, model_type, key, value."""
    wanted = list(metrics) if metrics is not None else [
        c for c in leaderboard.columns if c != model
    ]
    unknown = [m for m in wanted if m not in leaderboard.columns]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    top = ordered_leaderboard(leaderboard, order_by.lower(), model).where(F.col("rowname") <= n_max)
    named = top.withColumn(model, F.concat(F.col("rowname").cast("string"), F.lit(". "), F.col(model)))
    return lengthen(named.select("rowname", model, "model_type", *wanted), wanted, "key", "value", ids=["rowname", model, "model_type"])


def performance_pack(
    scored: DataFrame, order_by: str = "auc", max_models: int = 3, model: str = "model_id"
) -> tuple[DataFrame, DataFrame]:
    """Threshold and gain tables of the best models, each row with its model's position and metric."""
    if order_by not in ("auc", "logloss"):
        raise ValueError(f"models are ordered by auc or logloss, not by {order_by!r}")
    best = ordered_leaderboard(binary_leaderboard(scored, model), order_by, model).where(
        F.col("rowname") <= max_models
    ).select(model, "rowname", order_by)
    thresholds = threshold_table(scored, [model]).join(best, model)
    gains = gain_lift(scored, [model]).withColumnsRenamed({"cumulative_capture_rate": "gain", "cumulative_lift": "lift"})
    return thresholds, gains.join(best, model)
