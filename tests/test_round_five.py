"""What the round's findings asked for: rows of a search are assembled once, values are counted once."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from fathom.operators.models import fold_predictions, model_recipe, search, with_label
from fathom.operators.prep import value_frequencies
from fathom.operators.resample import with_folds
from fathom.plans import training
from fathom.session import materialise, new_path


def table(spark, n=400):
    return spark.range(n).select(
        F.col("id"), (F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 73 % 17).cast("double").alias("b c"),
        F.when(F.col("id") * 37 % 101 + F.col("id") % 13 * 9 > 100, "yes").otherwise("no").alias("kind"),
    ).withColumn("y", F.col("a") * 2 - F.col("b c") + F.col("id") % 5)


def largest_difference(found, plain, column):
    both = found.holdout.select("id", F.col(column).alias("x")).join(plain.select("id", F.col(column).alias("z")), "id")
    row = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("z"))).alias("d")).first()
    return row.n, row.d


@pytest.mark.parametrize("gaps", [False, True])
def test_search_equals_plain_fits_of_each_fold(spark, gaps):
    df = table(spark)
    if gaps:
        odd = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 0, None)
        df = df.withColumn("a", F.when(F.col("id") % 21 == 0, odd).when(F.col("id") % 7 == 0, odd).otherwise(F.col("a")))
    features = ["a", "b c"]
    for outcome, labels, make, column in (
        ("kind", ["no", "yes"], lambda: LogisticRegression(regParam=0.01), "p_yes"), ("y", None, lambda: LinearRegression(regParam=0.01), "predict"),
    ):
        found = search(df, outcome, features, "id", nfolds=4, candidates={"GLM_1": make}, keep_fold_models=True)
        rows = with_label(df, outcome, labels) if labels else df
        rows = materialise(with_folds(rows, "id", 4, strata=outcome if labels else None, seed=1), "plain")
        recipe = lambda: model_recipe(make(), features, outcome, labels)
        n, gap = largest_difference(found, fold_predictions(rows, recipe, range(4), ["id", column]), column)
        assert n == 400 and gap < 1e-8
        # Kept models and the final one read plain rows, with absent inputs as well.
        whole = recipe().fit(rows).transform(df.drop("a")).agg(F.sum(column)).first()[0]
        assert np.isclose(found.models["GLM_1"].transform(df.drop("a")).agg(F.sum(column)).first()[0], whole)
        part = found.fold_models["GLM_1"][2].transform(rows.where("fold = 2").drop("fold")).select("id", column)
        assert part.join(found.holdout.select("id", F.col(column).alias("z")), "id").where(f"abs({column} - z) > 1e-9").count() == 0


def test_search_assembles_rows_once(spark, monkeypatch):
    calls = {"assembled": 0, "rows imputed from": 0}
    transform, fit = VectorAssembler.transform, Imputer.fit

    def counted(self, df, *more):
        calls["assembled"] += 1
        return transform(self, df, *more)

    def measured(self, df, *more):
        calls["rows imputed from"] = max(calls["rows imputed from"], df.count())
        return fit(self, df, *more)

    monkeypatch.setattr(VectorAssembler, "transform", counted)
    monkeypatch.setattr(Imputer, "fit", measured)
    many = {f"GLM_{i}": lambda i=i: LinearRegression(regParam=i / 10) for i in (1, 2)}
    found = search(table(spark), "y", ["a", "b c"], "id", nfolds=5, candidates=many)
    assert calls == {"assembled": 1, "rows imputed from": 1}
    assert found.holdout.count() == 800 and found.leaderboard.count() == 2


def test_values_are_counted_once(spark):
    df = materialise(table(spark), "counted")
    found = value_frequencies(df, ["a", "kind"])
    assert not set(df.inputFiles()) & set(found.inputFiles())
    rows = {r.feature: r for r in found.collect()}
    truth = sorted((r["count"] for r in df.groupBy("a").count().collect()), reverse=True)
    a = rows["a"]
    assert (a.n_rows, a.n_distinct, a.most, a.second_most) == (400, len(truth), truth[0], truth[1])


def test_test_rows_are_prepared_while_models_are_searched(spark, monkeypatch):
    begun = threading.Event()
    searched, prepared = training.search, training.materialise

    def waits(*given, **named):
        assert begun.wait(60) and not done.is_set()
        found = searched(*given, **named)
        done.set()
        return found

    def begins(df, label):
        begun.set()
        assert done.wait(200)
        return prepared(df, label)

    done = threading.Event()
    monkeypatch.setattr(training, "search", waits)
    monkeypatch.setattr(training, "materialise", begins)
    found = training.train_regression(
        table(spark).select("id", "a", "b c", "y"), "y", "id", new_path(spark, "models"), nfolds=2, correlation=0.0,
        candidates={"GLM_1": lambda: LinearRegression(regParam=0.01)}, importance_repeats=1,
    )
    assert found.test.count() > 0 and found.figures.count() == 1
