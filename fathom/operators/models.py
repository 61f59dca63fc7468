"""Model families, automated search with cross-validation, scoring, the model store."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, RFormula, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import name_sql, names_sql, number_literal, quoted, with_expressions
from ..session import materialise
from .metrics import binary_leaderboard, class_metrics, multiclass_auc, regression_metrics, roc_auc
from .penalty import lasso_path
from .prep import _Settings
from .resample import summarise_metrics, with_folds
from .reshape import lengthen

PREDICTED = "predict"


class AddMissing(_Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Add absent model inputs as missing numbers, and read all inputs as doubles."""

    def _transform(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return with_expressions(
            df, {c: f"CAST({name_sql(c) if c in have else 'NULL'} AS DOUBLE)" for c in self["columns"]}
        )


class NameOutput(_Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Turn the model's raw columns into ``predict`` and one ``p_<class>`` column per class."""

    def _transform(self, df: DataFrame) -> DataFrame:
        labels = self["labels"]
        if labels is None:
            df = df.withColumn(PREDICTED, F.col("_prediction"))
        else:
            codes = F.array(*[F.lit(v) for v in labels])
            made = {PREDICTED: F.element_at(codes, F.col("_prediction").cast("int") + 1)}
            if "_probability" in df.columns:
                chances = vector_to_array("_probability")
            else:
                # one-against-rest models only rank the classes: their margins become shares
                margins = vector_to_array("_raw")
                odds = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
                total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
                chances = F.transform(odds, lambda o: o / total)
            made |= {probability_name(v): F.element_at(chances, i + 1) for i, v in enumerate(labels)}
            df = df.withColumns(made)
        hidden = [c for c in df.columns if c in ("_prediction", "_probability", "_raw", "_features", "_label") or c.startswith("_filled_")]
        return df.drop(*hidden)


def probability_name(level) -> str:
    return f"p_{level}"


def model_recipe(
    estimator: Estimator, features: Sequence[str], outcome: str, labels: Sequence[str] | None = None
) -> Pipeline:
    """Inputs completed by the training mean, assembled, fitted, and the output named.

    ``labels`` are the classes of a text outcome, in order.
    """
    features = list(features)
    stages: list = [
        AddMissing(columns=features),
        Imputer(inputCols=features, outputCols=[f"_filled_{c}" for c in features]),
        VectorAssembler(inputCols=[f"_filled_{c}" for c in features], outputCol="_features"),
    ]
    estimator.setFeaturesCol("_features")
    estimator.setPredictionCol("_prediction")
    if labels is None:
        estimator.setLabelCol(outcome)
    else:
        estimator.setLabelCol("_label")
        if estimator.hasParam("probabilityCol"):
            estimator.setProbabilityCol("_probability")
        if estimator.hasParam("rawPredictionCol"):
            estimator.setRawPredictionCol("_raw")
    stages += [estimator, NameOutput(labels=list(labels) if labels is not None else None)]
    return Pipeline(stages=stages)


def with_label(df: DataFrame, outcome: str, labels: Sequence[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), quoted(outcome))
    return df.withColumn("_label", F.nullif(place, F.lit(0)).cast("double") - 1.0)


def class_levels(df: DataFrame, outcome: str, limit: int = 200) -> list:
    found = df.select(quoted(outcome).alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{outcome} has more than {limit} classes")
    return sorted(r.v for r in found)


# --- single families ---------------------------------------------------------------------------


def logistic_formula(df: DataFrame, formula: str) -> PipelineModel:
    """Unpenalised logistic regression from a formula; rows with missing inputs are left out."""
    stages = [RFormula(formula=formula, handleInvalid="skip", featuresCol="_features", labelCol="_label"),
              LogisticRegression(featuresCol="_features", labelCol="_label", regParam=0.0)]
    return Pipeline(stages=stages).fit(df)


def lasso_multinomial(penalty: float) -> LogisticRegression:
    return LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=penalty, maxIter=100)


def bagged_trees(times: int = 25, min_rows_to_split: int = 10, seed: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=times, featureSubsetStrategy="all", minInstancesPerNode=max(1, min_rows_to_split // 2), maxDepth=10, seed=seed
    )


def boosted_trees(learn_rate: float = 0.3, rounds: int = 15, seed: int = 1) -> GBTRegressor:
    return GBTRegressor(stepSize=learn_rate, maxIter=rounds, seed=seed)


# --- search ------------------------------------------------------------------------------------


def regression_candidates(seed: int = 1) -> dict[str, Callable[[], Estimator]]:
    return {
        "GLM_1": lambda: LinearRegression(regParam=0.01, elasticNetParam=0.5),
        "DRF_1": lambda: RandomForestRegressor(numTrees=50, maxDepth=8, seed=seed),
        "GBM_1": lambda: GBTRegressor(maxIter=30, maxDepth=5, seed=seed),
        "GLM_2": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0),
        "DRF_2": lambda: RandomForestRegressor(numTrees=100, maxDepth=12, seed=seed),
        "GBM_2": lambda: GBTRegressor(maxIter=50, maxDepth=3, stepSize=0.05, seed=seed),
    }


def classification_candidates(classes: int, seed: int = 1) -> dict[str, Callable[[], Estimator]]:
    if classes == 2:
        gbm_1 = lambda: GBTClassifier(maxIter=30, maxDepth=5, seed=seed)
        gbm_2 = lambda: GBTClassifier(maxIter=50, maxDepth=3, stepSize=0.05, seed=seed)
    else:
        gbm_1 = lambda: OneVsRest(classifier=GBTClassifier(maxIter=15, maxDepth=5, seed=seed))
        gbm_2 = lambda: OneVsRest(classifier=GBTClassifier(maxIter=30, maxDepth=3, stepSize=0.05, seed=seed))
    return {
        "GLM_1": lambda: LogisticRegression(regParam=0.01),
        "DRF_1": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed),
        "GBM_1": gbm_1,
        "GLM_2": lambda: LogisticRegression(regParam=0.01, elasticNetParam=1.0),
        "DRF_2": lambda: RandomForestClassifier(numTrees=100, maxDepth=12, seed=seed),
        "GBM_2": gbm_2,
    }


@dataclass
class Search:
    """Fitted models, their leaderboard (best first) and the holdout predictions of every fold."""

    leaderboard: DataFrame
    models: dict[str, PipelineModel]
    holdout: DataFrame
    order_by: str
    fold_models: dict[str, list[PipelineModel]] = field(default_factory=dict)

    def name(self, position: int = 1) -> str:
        rows = self.leaderboard.orderBy("position").limit(position).collect()
        if len(rows) < position:
            raise IndexError(f"the leaderboard has {len(rows)} models")
        return rows[position - 1].model_id

    @property
    def leader(self) -> PipelineModel:
        return self.models[self.name(1)]


def fold_predictions(
    df: DataFrame, recipe: Callable[[], Pipeline], folds: Sequence[int], keep: Sequence[str], fold: str = "fold",
    parallelism: int = 4,
) -> DataFrame:
    """Fit on all but one fold, predict that one, for every fold; one table of the kept columns.

    Fits run a few at a time on the cluster; rows never leave it.
    """

    def one(i: int) -> tuple[int, PipelineModel]:
        return i, recipe().fit(df.where(F.col(fold) != i))

    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(inheritable_thread_target(df.sparkSession)(one), folds))
    result = None
    for i, model in fitted:
        part = model.transform(df.where(F.col(fold) == i)).select(*names_sql(keep))
        result = part if result is None else result.unionByName(part)
    return result


# Rows of a fold for each part of it that is read at once.
FOLD_ROWS = 50_000


@dataclass
class PreparedFolds:
    """Rows of a search with their folds, and what completes and assembles the inputs: for each fold the stages
    fitted without it, last those fitted on all rows.

    If no input is missing, all folds have the same inputs: they are assembled once and stored by fold, so that
    every fit and prediction of every candidate reads them as they are, and only those of its folds.
    """

    rows: DataFrame
    heads: list[list[Transformer]]
    assembled: bool

    def ready(self, rows: DataFrame, i: int) -> DataFrame:
        return rows if self.assembled else PipelineModel(self.heads[i]).transform(rows)

    def training(self, i: int) -> DataFrame:
        """All rows but those of fold ``i``; all rows for the place behind the last fold."""
        return self.ready(self.rows.where(F.col("fold") != i) if i < len(self.heads) - 1 else self.rows, i)

    def held_out(self, i: int) -> DataFrame:
        return self.ready(self.rows.where(F.col("fold") == i), i)


def prepare_folds(df: DataFrame, features: Sequence[str], key: str, keep: Sequence[str], nfolds: int) -> PreparedFolds:
    """Means of the features without each fold, from one pass over rows that have a ``fold``.

    ``keep`` are the other columns that estimators and predictions need.
    """
    features = list(features)
    typed = AddMissing(columns=features).transform(df)
    known = [f"nullif({c}, double('NaN'))" for c in names_sql(features)]
    found = typed.groupBy("fold").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.expr(f"sum({c}) AS s{j}") for j, c in enumerate(known)],
        *[F.expr(f"count({c}) AS n{j}") for j, c in enumerate(known)],
    ).collect()
    filled = [f"_filled_{c}" for c in features]
    heads: list[list[Transformer]] = []
    for i in range(nfolds + 1):
        used = [r for r in found if r.fold != i]
        counts = [sum(r[f"n{j}"] for r in used) for j in range(len(features))]
        sums = [math.fsum(r[f"s{j}"] or 0.0 for r in used) for j in range(len(features))]
        means = [f"{number_literal(s / n if n else None)} AS {name_sql(c)}" for s, n, c in zip(sums, counts, features)]
        # A row that holds the means has them as its means.
        imputer = Imputer(inputCols=features, outputCols=filled).fit(df.sparkSession.range(0, 1, 1, 1).selectExpr(*means))
        heads.append([AddMissing(columns=features), imputer, VectorAssembler(inputCols=filled, outputCol="_features")])
    rows = sum(r["_rows"] for r in found)
    if any(r[f"n{j}"] < r["_rows"] for r in found for j in range(len(features))):
        return PreparedFolds(df, heads, False)
    kept = dict.fromkeys(["fold", key, *keep])
    assembled = PipelineModel(heads[-1]).transform(df).select(*names_sql(kept), "_features")
    parts = max(1, -(-rows // (nfolds * FOLD_ROWS)))
    spread = assembled.repartition(nfolds * parts, "fold", F.pmod(F.xxhash64(quoted(key)), F.lit(parts)))
    return PreparedFolds(materialise(spread, "assembled", ["fold"]), heads, True)


def fit_folds(
    folds: PreparedFolds, recipe: Callable[[], Pipeline], keep: Sequence[str], parallelism: int = 4
) -> tuple[DataFrame, list[PipelineModel], PipelineModel]:
    """Holdout predictions, the model of each fold, and the model of all rows."""

    def one(i: int) -> list[Transformer]:
        *_, estimator, naming = recipe().getStages()
        return [estimator.fit(folds.training(i)), naming]

    # The fit on all rows is the longest and starts first.
    places = range(len(folds.heads))
    with ThreadPoolExecutor(parallelism) as pool:
        tails = list(pool.map(inheritable_thread_target(folds.rows.sparkSession)(one), reversed(places)))[::-1]
    parts = [PipelineModel(tails[i]).transform(folds.held_out(i)).select(*names_sql(keep)) for i in places[:-1]]
    models = [PipelineModel([*folds.heads[i], *tails[i]]) for i in places]
    return reduce(DataFrame.unionByName, parts), models[:-1], models[-1]


def search(
    train: DataFrame, outcome: str, features: Sequence[str], key: str, nfolds: int = 10, budget_seconds: float | None = None,
    candidates: dict[str, Callable[[], Estimator]] | None = None, order_by: str | None = None,
    leaderboard_frame: DataFrame | None = None, validation_frame: DataFrame | None = None,
    keep_fold_models: bool = False, seed: int = 1,
) -> Search:
    """Cross-validate several model families, all of them unless a time budget is given.

    A budget stops the search, after one model at least; the leaderboard lists the candidates that were
    then skipped, behind the others, without figures and with ``state`` "skipped".

    Metrics come from the holdout predictions, or from ``leaderboard_frame`` if it is given.
    With a ``validation_frame`` the leaderboard also holds its metrics.
    """
    text = dict(train.dtypes)[outcome] == "string"
    known = train.where(quoted(outcome).isNotNull())
    labels = class_levels(known, outcome) if text else None
    if text:
        known = with_label(known, outcome, labels)
        candidates = candidates or classification_candidates(len(labels), seed)
    else:
        candidates = candidates or regression_candidates(seed)
    folded = materialise(with_folds(known, key, nfolds, strata=outcome if text else None, seed=seed), "folds")
    folds = prepare_folds(folded, features, key, [outcome, *(["_label"] if text else [])], nfolds)
    outputs = [PREDICTED, *([probability_name(v) for v in labels] if text else [])]
    started, skipped = time.monotonic(), []
    models: dict[str, PipelineModel] = {}
    fold_models: dict[str, list[PipelineModel]] = {}
    holdout = None
    boards = []
    for model_id, make in candidates.items():
        if models and budget_seconds is not None and time.monotonic() - started > budget_seconds:
            skipped.append(model_id)
            continue
        recipe = lambda make=make: model_recipe(make(), features, outcome, labels)
        predicted, kept, models[model_id] = fit_folds(folds, recipe, ["fold", key, outcome, *outputs])
        predicted = materialise(predicted.withColumn("model_id", F.lit(model_id)), f"holdout-{model_id}")
        holdout = predicted if holdout is None else holdout.unionByName(predicted)
        if keep_fold_models:
            fold_models[model_id] = kept
        measured = lambda frame: models[model_id].transform(frame.where(quoted(outcome).isNotNull()))
        frames = [("", predicted if leaderboard_frame is None else measured(leaderboard_frame))]
        if validation_frame is not None:
            frames.append(("validation_", measured(validation_frame)))
        row = {"model_id": model_id}
        for prefix, frame in frames:
            found = _figures(frame, outcome, labels).first().asDict()
            row |= {prefix + name: float(v) if v is not None else None for name, v in found.items()}
        boards.append(row)
    order = order_by or ("rmse" if not text else "auc" if len(labels) == 2 else "mean_per_class_error")
    best_first = -1.0 if order in ("auc", "aucpr", "accuracy", "r2") else 1.0
    boards.sort(key=lambda r: (r[order] is None, best_first * (r[order] or 0.0), r["model_id"]))
    spark = train.sparkSession
    names = list(boards[0])
    schema = "position long, model_id string, state string, " + ", ".join(f"{n} double" for n in names if n != "model_id")
    rows = [(i + 1, r["model_id"], "fitted", *[r[n] for n in names if n != "model_id"]) for i, r in enumerate(boards)]
    rows += [(len(boards) + i + 1, m, "skipped", *[None] * (len(names) - 1)) for i, m in enumerate(skipped)]
    return Search(spark.createDataFrame(rows, schema).coalesce(1), models, holdout, order, fold_models)


def _figures(predicted: DataFrame, outcome: str, labels: Sequence | None) -> DataFrame:
    """One row of metrics for one model's predictions."""
    if labels is None:
        return regression_metrics(predicted, outcome, PREDICTED)
    if len(labels) == 2:
        scored = predicted.select(
            F.lit("m").alias("model_id"),
            (quoted(outcome) == F.lit(labels[1])).cast("int").alias("truth"),
            quoted(probability_name(labels[1])).alias("score"),
        )
        return binary_leaderboard(scored).drop("model_id")
    long = class_metrics(with_true_probability(predicted, outcome, labels), outcome, PREDICTED, probability="_true")
    wide = long.agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
          for m in ("mn_log_loss", "accuracy", "sensitivity", "specificity")]
    )
    return wide.withColumn("mean_per_class_error", 1.0 - F.col("sensitivity")).withColumnRenamed("mn_log_loss", "logloss")


def with_true_probability(df: DataFrame, outcome: str, labels: Sequence, name: str = "_true") -> DataFrame:
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), quoted(outcome))
    chances = F.array(*[quoted(probability_name(v)) for v in labels])
    return df.withColumn(name, F.get(chances, (place - 1).cast("int")))


# --- resampling and tuning ---------------------------------------------------------------------


def fold_figures(
    predicted: DataFrame, outcome: str, labels: Sequence, groups: Sequence[str]
) -> DataFrame:
    """metric and value per group of holdout predictions."""
    figures = class_metrics(with_true_probability(predicted, outcome, labels), outcome, PREDICTED, groups, "_true")
    if len(labels) != 2:
        columns = {v: probability_name(v) for v in labels}
        auc = multiclass_auc(predicted, outcome, columns, groups)
        return figures.unionByName(auc.select(*groups, F.lit("roc_auc").alias("metric"), F.col("auc").alias("value")))
    scored = predicted.select(
        *groups,
        (quoted(outcome) == F.lit(labels[1])).cast("int").alias("truth"),
        quoted(probability_name(labels[1])).alias("score"),
    )
    auc = roc_auc(scored, groups).select(*groups, F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    return figures.unionByName(auc)


def fit_resamples(
    df: DataFrame, recipe: Callable[[], Pipeline], outcome: str, labels: Sequence, v: int, key: str, fold: str = "fold"
) -> DataFrame:
    """metric, fold, value of a classifier over given folds."""
    keep = [fold, key, outcome, PREDICTED, *[probability_name(x) for x in labels]]
    predicted = materialise(fold_predictions(df, recipe, range(v), keep, fold), "resamples")
    return fold_figures(predicted, outcome, labels, [fold])


def fit_prepared(
    ready: DataFrame, recipe: Callable[[], Pipeline], outcome: str, labels: Sequence, v: int, key: str, parallelism: int = 4
) -> DataFrame:
    """metric, split_id, value of a classifier over rows prepared per fold (``part`` Analysis or Assessment)."""
    columns = [PREDICTED, *[probability_name(x) for x in labels]]

    def one(i: int) -> PipelineModel:
        return recipe().fit(ready.where(f"split_id = {i} AND part = 'Analysis'"))

    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(inheritable_thread_target(ready.sparkSession)(one), range(v)))
    parts = [
        m.transform(ready.where(f"split_id = {i} AND part = 'Assessment'")).select("split_id", *names_sql([key, outcome, *columns]))
        for i, m in enumerate(fitted)
    ]
    predicted = materialise(reduce(DataFrame.unionByName, parts), "resamples")
    return fold_figures(predicted, outcome, labels, ["split_id"])


def tune_penalty(
    df: DataFrame, penalties: Sequence[float], features: Sequence[str], outcome: str, labels: Sequence, v: int, key: str,
    fold: str = "fold",
) -> DataFrame:
    """penalty, metric, fold, value of the lasso classifier over a grid; one path holds all penalties and folds."""
    path = lasso_path(df, features, outcome, labels, penalties, fold, v)
    predicted = path.predict(df, [fold, key, outcome], fold=fold)
    return fold_figures(materialise(predicted, "tuning"), outcome, labels, ["penalty", fold])


def compare_resampling(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("random", "spatial")) -> DataFrame:
    """Mean and standard error of each metric under two ways of resampling, side by side."""
    parts = [
        summarise_metrics(t).select("metric", F.col("mean").alias(f"{n}_mean"), F.col("std_err").alias(f"{n}_std_err"))
        for t, n in zip((first, second), names)
    ]
    return parts[0].join(parts[1], "metric", "full")


def last_fit(
    train: DataFrame, test: DataFrame, recipe: Callable[[], Pipeline], outcome: str, labels: Sequence
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """The final model, its predictions on the test rows, and their metrics."""
    model = recipe().fit(with_label(train, outcome, labels))
    predicted = model.transform(test)
    figures = class_metrics(with_true_probability(predicted, outcome, labels), outcome, PREDICTED, probability="_true")
    return model, predicted, figures


# --- store and scoring -------------------------------------------------------------------------


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_search(result: Search, path: str, n: int = 15) -> list[str]:
    """Save the n best models below ``path``, each under its name."""
    best = result.leaderboard.where("state = 'fitted'").orderBy("position").limit(n).collect()
    names = [r.model_id for r in best]
    for name in names:
        save_model(result.models[name], f"{path}/{name}")
    return names


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predictions beside the inputs."""
    return model.transform(rows)


def score_long(model: PipelineModel, rows: DataFrame, key: str, inputs: Sequence[str], outcome: str = "temperature") -> DataFrame:
    """One (name, value) row for the prediction and for each input, per scored row."""
    scored = score(model, rows).withColumnRenamed(PREDICTED, outcome)
    names = [outcome, *[c for c in inputs if c != outcome]]
    return lengthen(scored.select(key, *names_sql(names)), names, "name", "value", ids=[key], cast="double")


def scoring_rows(spark: SparkSession, rows: Sequence[Sequence[float]]) -> DataFrame:
    """Requests as typed rows with an id."""
    return spark.createDataFrame(
        [(i, *[float(x) for x in r]) for i, r in enumerate(rows)],
        "row_id long, lat double, section_id_AMT28 double, section_id_P18 double, dop_darwin_clim double",
    )
