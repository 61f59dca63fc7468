"""Preprocessing, neighbours, resampling, models and explanation against brute force and invariants."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from fathom.operators.explain import (
    accumulated_dependence, break_down, importance_summary, partial_dependence, permutation_importance, shapley,
)
from fathom.operators.models import model_recipe, save_search, score_long, search
from fathom.operators.neighbours import Space, nearest_rows
from fathom.operators.prep import (
    CategoryCodes, Dummies, LumpRare, ModeImpute, NearZeroVariance, NeighbourImpute, Normalise, NovelLevel,
    PowerTransform, TargetImpute, UnknownLevel, best_powers, smote,
)
from fathom.operators.resample import penalty_grid, random_split, with_folds, with_spatial_folds, with_stratified_split
from fathom.plans.features import fit_features
from fathom.plans.training import train_regression
from fathom.session import new_path


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(3)
    data = []
    for i in range(240):
        a, b = draw.normal(0, 1), draw.choice([0.0, 5.0]) + draw.normal(0, 0.3)
        data.append((f"k{i:03d}", float(a), None if i % 11 == 0 else float(b), None if i % 7 == 0 else float(a + b),
                     ["u", "v", None][i % 3], "big" if i % 5 else "small"))
    return spark.createDataFrame(data, "id string, a double, b double, c double, t string, g string").cache()


def mean_gap(p, q, ranges):
    total = weight = 0.0
    for name in ("a", "b", "c"):
        if p[name] is not None and q[name] is not None:
            total += abs(p[name] - q[name]) / ranges[name]
            weight += 1
    if p["t"] is not None and q["t"] is not None:
        total += p["t"] != q["t"]
        weight += 1
    return total / weight if weight else 1.0


@pytest.mark.parametrize("cell_rows", [20000, 30, 7])
def test_imputation_equals_brute_force(points, cell_rows):
    table = [r.asDict() for r in points.collect()]
    ranges = {n: max(r[n] for r in table if r[n] is not None) - min(r[n] for r in table if r[n] is not None) for n in "abc"}
    step = NeighbourImpute(key="id", exclude=["id", "g"], cell_rows=cell_rows)
    got = {r.id: r for r in step.fit(points).transform(points).collect()}
    for row in table:
        for name in "abc":
            if row[name] is not None:
                assert got[row["id"]][name] == row[name]
                continue
            others = sorted(
                ((mean_gap(row, o, ranges), o["id"], o[name]) for o in table if o["id"] != row["id"] and o[name] is not None)
            )[:5]
            assert got[row["id"]][name] == pytest.approx(sum(o[2] for o in others) / 5, abs=1e-6)


@pytest.mark.parametrize("cell_rows", [20000, 15])
def test_nearest_within_groups_equals_brute_force(points, cell_rows):
    known = points.where("b IS NOT NULL")
    table = [r.asDict() for r in known.collect()]
    found = nearest_rows(known, known, "id", Space(["a", "b"], euclidean=True), 3, within="g", cell_rows=cell_rows).collect()
    got = {}
    for r in found:
        got.setdefault(r.id, {})[r.rank] = r.donor
    assert len(got) == len(table)
    for row in table:
        others = sorted(
            (math.sqrt((row["a"] - o["a"]) ** 2 + (row["b"] - o["b"]) ** 2), o["id"])
            for o in table if o["id"] != row["id"] and o["g"] == row["g"]
        )[:3]
        assert [got[row["id"]][i + 1] for i in range(3)] == [o[1] for o in others]


def test_one_repeated_point_may_fill_many_blocks(spark):
    same = spark.range(60).selectExpr("concat('k', lpad(id, 3, '0')) AS id", "CASE WHEN id < 50 THEN 1.0D ELSE CAST(id AS DOUBLE) END AS x")
    found = nearest_rows(same, same, "id", Space(["x"], euclidean=True), 2, cell_rows=8)
    assert found.count() == 120
    assert found.where("id = 'k000'").orderBy("rank").first().donor == "k001"


def test_oversampling_balances_classes(points):
    known = points.where("b IS NOT NULL").select("id", "a", "b", "g")
    made = smote(known, "g", "id", over_ratio=1.0)
    sizes = {r.g: r["count"] for r in made.groupBy("g").count().collect()}
    assert len(set(sizes.values())) == 1
    assert made.select("id").distinct().count() == made.count()
    bounds = known.where("g = 'small'").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).first()
    new = made.where("synthetic").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).first()
    assert bounds.lo <= new.lo and new.hi <= bounds.hi
    again = smote(known.repartition(5), "g", "id", over_ratio=1.0)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, again.collect()))
    half = smote(known, "g", "id", over_ratio=0.5)
    sizes = {r.g: r["count"] for r in half.groupBy("g").count().collect()}
    assert sizes["small"] == sizes["big"] // 2


def test_power_fit_finds_the_logarithm(spark):
    df = spark.range(2000).selectExpr("exp(2 * sin(id) + cos(id * 7)) - 1 AS x", "sin(id * 3) AS y")
    assert abs(best_powers(df, ["x", "y"])["x"]) < 0.35
    bent = PowerTransform(columns=["x"]).fit(df).transform(df)
    before, after = df.agg(F.skewness("x")).first()[0], bent.agg(F.skewness("x")).first()[0]
    assert abs(after) < abs(before) / 3


def test_fitted_steps_survive_saving(spark, points):
    recipe = Pipeline(stages=[
        NeighbourImpute(key="id", exclude=["id", "g"]),
        ModeImpute(exclude=["id", "g"]),
        Normalise(exclude=["id", "g"]),
        NovelLevel(columns=["g"]),
        LumpRare(columns=["t"], threshold=0.4),
        Dummies(exclude=["id", "g"], one_hot=True),
        NearZeroVariance(exclude=["id", "g"]),
    ])
    model = recipe.fit(points)
    path = new_path(spark, "recipe")
    model.write().save(path)
    loaded = PipelineModel.load(path)
    first, second = (sorted(map(str, m.transform(points).collect())) for m in (model, loaded))
    assert first == second and len(first) == points.count()


def test_target_imputation_survives_saving(spark, points):
    step = TargetImpute(target="c", exclude=["id"]).fit(points)
    path = new_path(spark, "target")
    step.save(path)
    from fathom.operators.prep import TargetImputeModel

    loaded = TargetImputeModel.read().load(path)
    a, b = (sorted(map(str, m.transform(points).collect())) for m in (step, loaded))
    assert a == b and step.transform(points).where("c IS NULL").count() == 0


def test_levels(spark):
    train = spark.createDataFrame([("a",)] * 20 + [("b",)] * 19 + [("c",)], "l string")
    new = spark.createDataFrame([("a",), ("c",), ("d",), (None,)], "l string")
    assert [r[0] for r in LumpRare(columns=["l"]).fit(train).transform(new).collect()] == ["a", "other", "other", None]
    assert sorted(map(str, [r[0] for r in NovelLevel(columns=["l"]).fit(train).transform(new).collect()])) == ["None", "a", "c", "new"]
    assert [r[0] for r in UnknownLevel(columns=["l"]).transform(new).collect()] == ["a", "c", "d", "unknown"]
    assert [r[0] for r in CategoryCodes(columns=["l"]).fit(train).transform(new).collect()] == [1, 3, None, None]
    full = Dummies(columns=["l"], one_hot=True).fit(train).transform(train)
    assert full.agg(F.min(F.col("l_a") + F.col("l_b") + F.col("l_c"))).first()[0] == 1.0


def test_splits_depend_on_keys_only(spark):
    df = spark.range(3000).selectExpr("id", "id % 4 AS s", "CAST(id % 19 AS DOUBLE) AS lon", "CAST(id % 23 AS DOUBLE) AS lat")
    first, again = (sorted(r.id for r in random_split(d, "id")[0].collect()) for d in (df, df.repartition(9)))
    assert first == again and 0.82 < len(first) / 3000 < 0.88
    shares = with_stratified_split(df, "s", "id").groupBy("s").agg(F.avg((F.col("split") == "train").cast("int")).alias("p")).collect()
    assert all(abs(r.p - 0.75) < 0.01 for r in shares)
    folds = with_folds(df, "id", 5, strata="s").groupBy("s", "fold").count().collect()
    assert len(folds) == 20 and {r["count"] for r in folds} == {150}
    located = df.withColumn("lon", F.when(F.col("id") > 5, F.col("lon")))
    assert with_spatial_folds(located, "id", v=4).count() == 3000


def test_penalty_grid():
    grid = penalty_grid()
    assert len(grid) == 20 and grid[0] == pytest.approx(1e-5) and grid[-1] == pytest.approx(1.0)


@pytest.fixture(scope="module")
def sloped(spark):
    return spark.range(600).selectExpr(
        "id", "sin(id) AS u", "cos(id * 3) AS v", "pmod(id * 7, 13) / 13 AS w", "3 * sin(id) + cos(id * 3) AS y"
    ).cache()


@pytest.fixture(scope="module")
def line(sloped):
    return model_recipe(LinearRegression(), ["u", "v", "w"], "y").fit(sloped)


def test_search_beats_the_mean(spark, sloped):
    found = search(
        sloped, "y", ["u", "v", "w"], "id", nfolds=3, keep_fold_models=True,
        candidates={"GLM_1": lambda: LinearRegression(), "GBM_1": lambda: GBTRegressor(maxIter=3, seed=1)},
    )
    board = found.leaderboard.orderBy("position").collect()
    spread = sloped.agg(F.stddev_pop("y")).first()[0]
    assert board[0].rmse < spread / 2 and found.name(1) == board[0].model_id
    assert found.holdout.groupBy("model_id").count().where("count = 600").count() == 2
    assert len(found.fold_models["GLM_1"]) == 3
    names = save_search(found, new_path(spark, "models"), 15)
    assert names == [r.model_id for r in board]


def test_search_stops_at_its_budget(sloped):
    slow = {f"GLM_{i}": (lambda: LinearRegression()) for i in range(4)}
    found = search(sloped, "y", ["u"], "id", nfolds=2, budget_seconds=0, candidates=slow)
    assert len(found.models) == 1
    board = [(r.model_id, r.state, r.rmse is None) for r in found.leaderboard.orderBy("position").collect()]
    assert board == [("GLM_0", "fitted", False), *[(f"GLM_{i}", "skipped", True) for i in (1, 2, 3)]]
    assert {r.state for r in search(sloped, "y", ["u"], "id", nfolds=2, candidates=slow).leaderboard.collect()} == {"fitted"}


def test_scoring_adds_absent_inputs(line, sloped):
    long = score_long(line, sloped.select("id", "u"), "id", ["u", "v", "w"], outcome="y")
    assert long.count() == 600 * 4
    assert long.where("name = 'y' AND value IS NULL").count() == 0


def test_permutation_ranks_features(line, sloped):
    found = {r.feature: r.importance for r in importance_summary(permutation_importance(line, sloped, ["u", "v", "w"], "y", "id", 3)).collect()}
    assert found["u"] > found["v"] > found["w"] and abs(found["w"]) < 0.01


def test_contributions_add_up(line, sloped):
    picked = sloped.where("id IN (3, 4)")
    predictions = {str(r.id): r.predict for r in line.transform(picked).collect()}
    mean = line.transform(sloped).agg(F.avg("predict")).first()[0]
    for table in (
        break_down(line, sloped, picked, ["u", "v", "w"], "id"),
        shapley(line, sloped, picked, ["u", "v", "w"], "id", samples=4),
    ):
        for r in table.where("feature <> '(mean)'").groupBy("id").agg(F.sum("contribution").alias("s")).collect():
            assert r.s == pytest.approx(predictions[r.id] - mean, abs=1e-6)


def test_dependence_of_a_line_is_its_slope(line, sloped):
    for table, value in ((partial_dependence(line, sloped, ["u", "v", "w"]), "mean"), (accumulated_dependence(line, sloped, ["u", "v", "w"]), "effect")):
        profile = table.where("feature = 'u'").orderBy("x").collect()
        slopes = [(b[value] - a[value]) / (b.x - a.x) for a, b in zip(profile, profile[1:])]
        assert all(s == pytest.approx(3.0, abs=0.05) for s in slopes)


def test_recipe_and_training(spark, sloped):
    df = sloped.selectExpr(
        "CAST(id AS STRING) AS id", "u", "CASE WHEN id % 9 = 0 THEN NULL ELSE v END AS v", "exp(3 * w) AS w",
        "CASE WHEN id % 2 = 0 THEN 'p' ELSE 'q' END AS t", "CAST(NULL AS DOUBLE) AS gone", "y",
    )
    recipe = fit_features(df, "y", "id")
    assert recipe.removed == ["gone"] and recipe.imputed == ["v"] and {"u", "v"} <= set(recipe.selected)
    baked = recipe.apply(df)
    assert sorted(map(str, baked.collect())) == sorted(map(str, recipe.training.select(*baked.columns).collect()))
    assert baked.count() == 600 and baked.where("v IS NULL").count() == 0
    result = train_regression(
        df, "y", "id", new_path(spark, "training"), nfolds=2, importance_repeats=2,
        candidates={"GLM_1": lambda: LinearRegression(), "DRF_1": lambda: RandomForestRegressor(numTrees=5, seed=1)},
    )
    assert result.figures.first().r2 > 0.9
    assert result.importance.orderBy(F.col("importance").desc()).first().feature == "u"
    assert len(result.saved) == 2
