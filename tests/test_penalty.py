import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fathom.operators.models import tune_penalty
from fathom.operators.penalty import lasso_path, lasso_violations
from fathom.operators.resample import penalty_grid

FEATURES = ["a", "b", "c d", "flat"]


def table(spark, n=600, missing=0.0, seed=3):
    draw = np.random.default_rng(seed)
    a, noise = draw.normal(size=n), draw.normal(size=n)
    b = 50 + 10 * (a + 0.1 * noise)  # nearly the same as a, on another scale
    c = draw.exponential(size=n) * 1e4
    margin = np.column_stack([1.5 * a, 0.5 * noise + c / 1e4, -a - 1.0])
    kind = [["x", "y", "z"][k] for k in (margin + draw.gumbel(size=(n, 3))).argmax(axis=1)]
    hide = draw.random((n, 3)) < missing
    values = [[None if h else float(v) for v, h in zip(row, hid)] for row, hid in zip(np.column_stack([a, b, c]), hide)]
    rows = [(i, i % 4, *v, 1.0, k) for i, (v, k) in enumerate(zip(values, kind))]
    return spark.createDataFrame(rows, "key int, fold int, a double, b double, `c d` double, flat double, kind string").repartition(6)


def by_solver(df, penalty, fold):
    """Probabilities of the held-out rows by a general solver, inputs completed by training means."""
    train = df if fold is None else df.where(F.col("fold") != fold)
    means = train.agg(*[F.avg(f"`{c}`").alias(c) for c in FEATURES]).first().asDict()
    code = F.array_position(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("kind")) - 1
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        df.fillna(means).withColumn("label", code.cast("double"))
    )
    model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=penalty, maxIter=300, tol=1e-8)
    fitted = model.fit(ready if fold is None else ready.where(F.col("fold") != fold))
    scored = fitted.transform(ready if fold is None else ready.where(F.col("fold") == fold))
    return {r.key: list(r.p) for r in scored.select("key", vector_to_array("probability").alias("p")).collect()}


@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_path_equals_separate_fits(spark, missing):
    df = table(spark, missing=missing)
    grid = [10.0**-4, 0.01, 0.1]
    path = lasso_path(df, FEATURES, "kind", ["x", "y", "z"], grid, "fold", 4)
    assert path.steps < 200
    held, whole = path.predict(df, ["key", "fold"], fold="fold").collect(), path.predict(df, ["key", "fold"]).collect()
    # The general solver stops short of the optimum where inputs are alike, so it is no judge of tiny penalties.
    for penalty in grid[1:]:
        for fold, rows in ((2, held), (None, whole)):
            want = by_solver(df, penalty, fold)
            got = {r.key: [r.p_x, r.p_y, r.p_z] for r in rows if r.penalty == penalty and r.key in want}
            assert got.keys() == want.keys()
            assert max(abs(np.subtract(got[k], want[k])).max() for k in want) < 3e-3


def test_coefficients_meet_the_optimality_conditions(spark):
    df = table(spark, missing=0.1)
    path = lasso_path(df, FEATURES, "kind", ["x", "y", "z"], [0.02, 0.3, 1.0])
    rows = df.toPandas()
    raw = rows[FEATURES].to_numpy(float)
    mean = np.nanmean(raw, axis=0)
    x = np.where(np.isnan(raw), mean, raw) - mean
    deviation = x.std(axis=0, ddof=1)
    deviation[deviation == 0] = 1
    z = x / deviation
    truth = np.column_stack([rows["kind"] == c for c in "xyz"]).astype(float)
    for k, penalty in enumerate(path.penalties):
        beta = path.weights[-1, k] * deviation
        margin = z @ beta.T + path.intercepts[-1, k] + path.weights[-1, k] @ mean
        p = np.exp(margin - margin.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = (p - truth).T @ z / len(z)
        used = beta != 0
        assert np.allclose(slope[used], -penalty * np.sign(beta[used]), atol=1e-4)
        assert (np.abs(slope[~used]) <= penalty + 1e-4).all()
        assert np.allclose((p - truth).mean(axis=0), 0, atol=1e-4)
    assert not path.weights[-1, 2].any()  # a penalty that leaves nothing
    assert lasso_violations(path, df, "kind").agg({"violation": "max"}).first()[0] < 1e-4
    terms = path.coefficients(spark)
    assert terms.count() == 3 * 3 * 5 and terms.where("term = 'flat' AND estimate <> 0").isEmpty()


def test_two_classes_odd_rows_and_order_of_penalties(spark):
    df = table(spark).withColumn("kind", F.expr("CASE WHEN kind = 'z' THEN 'x' WHEN key = 5 THEN NULL WHEN key = 6 THEN 'other' ELSE kind END"))
    up, down = (lasso_path(df, FEATURES, "kind", ["x", "y"], grid, "fold", 4) for grid in ([0.01, 0.05], [0.05, 0.01]))
    assert np.allclose(up.weights, down.weights[:, ::-1]) and up.penalties == [0.01, 0.05]
    one = spark.createDataFrame([(1, 0, 1.0, None, 2.0, 1.0, "x")], df.schema)
    alone = lasso_path(one, FEATURES, "kind", ["x", "y"], [0.1])
    assert not alone.weights.any() and alone.predict(one, ["key"]).first().predict == "x"


def test_tuning_gives_all_figures_for_all_penalties_and_folds(spark):
    grid = penalty_grid(-5, 0, 20)
    figures = tune_penalty(table(spark), grid, FEATURES, "kind", ["x", "y", "z"], 4, "key")
    rows = figures.collect()
    names = {"accuracy", "mn_log_loss", "sensitivity", "specificity", "roc_auc"}
    assert {(r.penalty, r.fold, r.metric) for r in rows} == {(p, f, m) for p in grid for f in range(4) for m in names}
    assert len(rows) == 20 * 4 * 5
    auc = {p: np.mean([r.value for r in rows if r.penalty == p and r.metric == "roc_auc"]) for p in grid}
    assert auc[grid[0]] > 0.7 and auc[grid[-1]] == 0.5
