"""Recipes inside folds, pairs of columns by blocks, powers by their root, class pairs, shared feature subsets."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import Transformer
from pyspark.sql import functions as F

from fathom.operators.chartdata import density
from fathom.operators.explain import contributions, permutation_importance, shift_of
from fathom.operators.fold_recipe import fit_fold_recipe
from fathom.operators.metrics import multiclass_auc
from fathom.operators.neighbours import Space
from fathom.operators.power import best_powers, transformed
from fathom.operators.prep import smote
from fathom.operators.products import pair_products
from fathom.operators.profile import correlation_matrix


def test_class_pairs_equal_all_pairs_of_rows(spark):
    draw = random.Random(2)
    rows = [(draw.choice("xyzz"), draw.choice([1, 1, 2]), *[round(draw.random(), 1) for _ in "xyz"]) for _ in range(300)]
    rows += [(None, 1, 0.5, 0.5, 0.5), ("x", 1, None, 0.5, 0.5), ("other", 1, 0.5, 0.5, 0.5), ("x", 3, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "kind string, g int, `p.x` double, py double, pz double")
    got = {r.g: r.auc for r in multiclass_auc(df.withColumnRenamed("p.x", "px"), "kind", {"x": "px", "y": "py", "z": "pz"}, ["g"]).collect()}
    for g in (1, 2):
        own = [r for r in rows if r[1] == g and r[0] in ("x", "y", "z")]
        shares = []
        for i, j in [(a, b) for a in "xyz" for b in "xyz" if a != b]:
            at = 2 + "xyz".index(i)
            pairs = [(a[at], b[at]) for a in own if a[0] == i and a[at] is not None for b in own if b[0] == j and b[at] is not None]
            shares.append(sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs))
        assert got[g] == pytest.approx(sum(shares) / len(shares), abs=1e-12)
    assert got[3] is None


def folded(spark):
    draw = random.Random(5)
    rows = []
    for i in range(200):
        kind = "rare" if i % 9 == 0 else "common"
        rows.append((i, i % 5, kind, None if i % 11 == 0 else draw.gauss(0, 1), 7.0 if i % 5 else 3.0 + i, draw.choice(["a", "b", None]) if i != 3 else "odd"))
    return rows, spark.createDataFrame(rows, "id long, fold int, kind string, u double, v double, t string")


def test_statistics_of_folds_leave_the_fold_out(spark):
    rows, df = folded(spark)
    recipe = fit_fold_recipe(df, "kind", "id", ["u", "v"], ["t"], 5, threshold=0.01)
    for held in range(5):
        rest = [r for r in rows if r[1] != held]
        u = [r[3] for r in rest if r[3] is not None]
        assert recipe.means["u"][held] == pytest.approx(np.mean(u), abs=1e-12)
        assert recipe.deviations["u"][held] == pytest.approx(np.std(u, ddof=1), abs=1e-12)
        assert recipe.constant["v"][held] == (held == 0)
        known = [r[5] for r in rest if r[5] is not None]
        assert recipe.levels["t"][held] == sorted({x for x in known if known.count(x) >= 0.01 * len(known)})


def test_only_training_rows_are_added_to(spark):
    rows, df = folded(spark)
    recipe = fit_fold_recipe(df, "kind", "id", ["u", "v"], ["t"], 5)
    plain = {(r.split_id, r.id): r for r in recipe.prepared(df).collect()}
    assert len(plain) == 5 * len(rows)
    made = recipe.balanced(df).collect()
    held = {r[0]: r[1] for r in rows}
    for r in made:
        if not r.synthetic:
            assert (r.part == "Assessment") == (held[int(r.id)] == r.split_id)
            assert all(r[c] == plain[r.split_id, int(r.id)][c] for c in recipe.features)
        else:
            # Made from a training row of its own fold.
            assert r.part == "Analysis" and r.kind == "rare" and held[int(r.id.split("+")[0])] != r.split_id
    for split in range(5):
        sizes = [sum(1 for r in made if r.split_id == split and r.part == "Analysis" and r.kind == k) for k in ("rare", "common")]
        assert sizes[0] == sizes[1]
    assert sum(r.part == "Assessment" for r in made) == len(rows)


def test_groups_are_oversampled_as_if_alone(spark):
    rows, df = folded(spark)
    known = df.select("id", "fold", "kind", "u", "v").where("u IS NOT NULL")
    together = smote(known, "kind", "id", columns=["u", "v"], group="fold")
    for fold in (0, 3):
        alone = smote(known.where(f"fold = {fold}"), "kind", "id", columns=["u", "v"])
        assert {r.kind: r["count"] for r in alone.groupBy("kind").count().collect()} == {
            r.kind: r["count"] for r in together.where(f"fold = {fold}").groupBy("kind").count().collect()
        }


def test_many_columns_by_blocks(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 500))
    x[:, 1] = 5.0
    x[draw.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in row] for row in x], [f"c{i}" for i in range(500)]).repartition(4)
    got = {(r.x, r.y): r.correlation for r in correlation_matrix(df, df.columns).collect()}
    assert len(got) == 500 * 499 // 2
    for i, j in [(0, 2), (3, 499), (63, 64), (128, 300), (0, 1)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        want = None if 1 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert got[f"c{i}", f"c{j}"] == (None if want is None else pytest.approx(want, abs=1e-10))


def test_pairs_by_group_and_small_tiles(spark):
    df = spark.range(40).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS a", "CAST(id * id % 7 AS DOUBLE) AS b", "IF(id % 3 = 0, NULL, id) AS c")
    one, two = (sorted(map(tuple, pair_products(df.repartition(3), ["a", "b", "c"], "g", t).collect())) for t in (64, 1))
    assert len(one) == 6 and all(p[:4] == q[:4] and np.allclose(p[4:], q[4:]) for p, q in zip(one, two))
    assert pair_products(df.limit(0), ["a", "b"]).collect() == []


def test_power_is_no_worse_than_a_fine_grid(spark):
    draw = np.random.default_rng(7)
    columns = {
        "wide": draw.exponential(size=3000) * 1e4, "both": draw.normal(size=3000), "below": -draw.exponential(size=3000) ** 2,
        "bound": draw.lognormal(size=3000) * 1e-3, "few": draw.choice([1.0, 2.0, 3.0], 3000),
    }
    values = [[float(v) for v in row] for row in zip(*columns.values())] + [[None] * 5]
    found = best_powers(spark.createDataFrame(values, ", ".join(f"{c} double" for c in columns)), list(columns))
    assert set(found) == set(columns) - {"few"}

    def likelihood(x, power):
        value, _ = transformed(x, power)
        return -len(x) / 2 * math.log(value.var()) + (power - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for c, power in found.items():
        best = max(likelihood(columns[c], p) for p in np.linspace(-5, 5, 1001))
        assert -5 <= power <= 5 and likelihood(columns[c], power) >= best - 1e-9 * abs(best)


class Sum(Transformer):
    """Predicts u * v + w and keeps count of what it is asked."""

    def __init__(self):
        super().__init__()
        self.asked = 0

    def _transform(self, df):
        self.asked += df.count()
        return df.withColumn("predict", F.col("u") * F.col("v") + F.col("w"))


def test_each_subset_of_features_is_scored_once(spark):
    background = spark.range(12).selectExpr("CAST(id AS DOUBLE) AS u", "CAST(id % 3 AS DOUBLE) AS v", "CAST(id % 5 AS DOUBLE) AS w", "id AS k")
    observed = background.where("k IN (2, 7)")
    draw, model = random.Random(1), Sum()
    orders = [draw.sample(["u", "v", "w"], 3) for _ in range(10)]
    table = contributions(model, background, observed, ["u", "v", "w"], "k", orders).collect()
    assert model.asked <= 12 * (1 + 2 * 7)
    rows = [(r.u, r.v, r.w) for r in background.collect()]
    mean = lambda own, fixed: np.mean([
        math.prod(own[i] if "uvw"[i] in fixed else r[i] for i in (0, 1)) + (own[2] if "w" in fixed else r[2]) for r in rows
    ])
    for r in table:
        own = rows[int(r.k)]
        order = orders[r.ordering]
        want = mean(own, ()) if r.feature == "(mean)" else mean(own, order[: order.index(r.feature) + 1]) - mean(own, order[: order.index(r.feature)])
        assert r.contribution == pytest.approx(want)
    assert len(table) == 2 * 10 * 4


def test_permutations_are_one_to_one(spark):
    assert all(1 <= shift_of(r, n) < n for n in (2, 3, 10, 1000) for r in range(1, 11)) and shift_of(3, 1) == 0
    df = spark.range(50).selectExpr("id AS k", "CAST(id AS DOUBLE) AS u", "1.0D AS v", "0.0D AS w", "CAST(id AS DOUBLE) AS y")
    table = {(r.feature, r.repeat): r for r in permutation_importance(Sum(), df, ["u", "v", "w"], "y", "k", 4).collect()}
    assert len(table) == 12 and all(table["v", r].rise == 0 and table["u", r].rise > 5 for r in range(1, 5))


def test_kernels_reach_what_doubles_hold(spark):
    draw = np.random.default_rng(3)
    values = [("f", "narrow", float(v)) for v in draw.normal(0, 0.01, 200)] + [("f", "wide", float(v)) for v in draw.normal(0, 30, 200)]
    df = spark.createDataFrame(values, "facet string, g string, x double")
    rows = density(df, "facet", "g", "x", points=512).collect()
    assert len(rows) == 1024
    own = sorted((r.x, r.density) for r in rows if r.g == "wide")
    assert sum(d for _, d in own) * (own[1][0] - own[0][0]) == pytest.approx(1.0, abs=0.03)
    # The narrow kernel is far below the grid's step: only points that hold values have a density.
    assert 0 < sum(r.density > 0 for r in rows if r.g == "narrow") <= 4


def test_distances_equal_the_definition():
    import pandas as pd

    draw = np.random.default_rng(4)
    rows = pd.DataFrame({"a": draw.normal(size=30), "b": draw.integers(0, 5, 30).astype(float), "flat": 1.0, "t": draw.choice(["x", "y", None], 30)})
    rows.loc[draw.random(30) < 0.3, "a"] = np.nan
    rows.loc[5, ["a", "b", "flat"]] = np.nan
    rows.loc[5, "t"] = None
    space = Space(["a", "b", "flat"], ["t"], {"a": 4.0, "b": 4.0, "flat": 0.0})
    ready = space.ready(rows)
    got = space.distances(ready, ready)
    for i, j in combinations(range(30), 2):
        total, known = 0.0, 0
        for c, width in (("a", 4.0), ("b", 4.0), ("flat", 0.0)):
            x, y = rows[c][i], rows[c][j]
            if not (math.isnan(x) or math.isnan(y)):
                known += 1
                total += abs(x - y) / width if width else 0.0
        if rows["t"][i] is not None and rows["t"][j] is not None:
            known += 1
            total += rows["t"][i] != rows["t"][j]
        assert got[i, j] == pytest.approx(total / known if known else 1.0, abs=1e-11)
