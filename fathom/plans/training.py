"""Train, evaluate, store and explain: the whole modelling job."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..operators.explain import importance_summary, permutation_importance
from ..operators.metrics import leaderboard_long, performance_pack, regression_metrics
from ..operators.models import PREDICTED, Search, class_levels, probability_name, save_search, search
from ..operators.resample import random_split
from ..session import materialise
from .features import FeatureRecipe, fit_features


@dataclass
class TrainingResult:
    recipe: FeatureRecipe
    search: Search
    test: DataFrame
    figures: DataFrame
    leaderboard: DataFrame
    importance: DataFrame
    saved: list[str]


def train_regression(
    table: DataFrame, outcome: str, key: str, path: str, ratio: float = 0.85, nfolds: int = 10,
    budget_seconds: float | None = None, correlation: float = 0.09, features: Sequence[str] | None = None, fit_on: str = "train",
    keep: int = 15, candidates=None, importance_repeats: int = 10,
) -> TrainingResult:
    """Split, fit the recipe, search models, measure them on the test rows, save them, explain the best.

    The recipe sees training rows only; ``fit_on="all"`` fits it before splitting instead.
    """
    train, test = random_split(table, key, ratio)
    recipe = fit_features(train if fit_on == "train" else table, outcome, key, correlation=correlation)
    chosen = list(features or recipe.selected)
    ready = recipe.training if fit_on == "train" else materialise(recipe.apply(train), "train")
    with ThreadPoolExecutor(1) as pool:
        held = prepared_beside(pool, recipe, test)
        found = search(ready, outcome, chosen, key, nfolds, budget_seconds, candidates)
        held = held.result()
    scored = found.leader.transform(held)
    importance = importance_summary(
        permutation_importance(found.leader, held, chosen, outcome, key, importance_repeats)
    )
    return TrainingResult(
        recipe, found, held, regression_metrics(scored, outcome, PREDICTED),
        leaderboard_long(found.leaderboard.where("state = 'fitted'").drop("position", "state"), found.order_by), importance, save_search(found, path, keep),
    )


def prepared_beside(pool: ThreadPoolExecutor, recipe: FeatureRecipe, test: DataFrame) -> Future[DataFrame]:
    """The test rows as the recipe prepares them, while models are searched: neither needs the other."""
    return pool.submit(inheritable_thread_target(test.sparkSession)(lambda: materialise(recipe.apply(test), "test")))


@dataclass
class ClassTrainingResult:
    recipe: FeatureRecipe
    search: Search
    test: DataFrame
    leaderboard: DataFrame
    thresholds: DataFrame
    gains: DataFrame
    importance: DataFrame
    saved: list[str]


def train_classification(
    table: DataFrame, outcome: str, key: str, path: str, ratio: float = 0.85, nfolds: int = 10,
    budget_seconds: float | None = None, correlation: float = 0.09, fit_on: str = "train", keep: int = 15, candidates=None,
    importance_repeats: int = 10, max_models: int = 3,
) -> ClassTrainingResult:
    """The job for a target of two classes: recipe, search by folds, threshold and gain tables of the best models
    on the test rows, saved models, and what permuting a feature does to the second class's probability.

    Rows without a target take part once the recipe has imputed it.
    """
    train, test = random_split(table, key, ratio)
    recipe = fit_features(train if fit_on == "train" else table, outcome, key, correlation=correlation)
    chosen = recipe.selected
    ready = recipe.training if fit_on == "train" else materialise(recipe.apply(train), "train")
    labels = class_levels(ready, outcome)
    if len(labels) != 2:
        raise ValueError(f"{outcome} has {len(labels)} classes, not two")
    with ThreadPoolExecutor(1) as pool:
        held = prepared_beside(pool, recipe, test)
        found = search(ready, outcome, chosen, key, nfolds, budget_seconds, candidates)
        held = held.result()
    positive = probability_name(labels[1])
    truth = (quoted(outcome) == F.lit(labels[1])).cast("int").alias("truth")
    scored = [
        model.transform(held).select(F.lit(name).alias("model_id"), truth, quoted(positive).alias("score"))
        for name, model in found.models.items()
    ]
    scored = materialise(reduce(DataFrame.unionByName, scored), "scored")
    thresholds, gains = performance_pack(scored, "auc", max_models)
    flagged = held.withColumn("_flag", truth.cast("double"))
    importance = permutation_importance(found.leader, flagged, chosen, "_flag", key, importance_repeats, output=positive)
    board = leaderboard_long(found.leaderboard.where("state = 'fitted'").drop("position", "state"), found.order_by)
    return ClassTrainingResult(
        recipe, found, held, board, thresholds, gains, importance_summary(importance), save_search(found, path, keep)
    )
