"""Faults of earlier states: tiny values, repeated keys, missing truths, many classes, hot groups."""

import pytest

from fathom.operators.explain import break_down, quantile_grids
from fathom.operators.metrics import class_metrics
from fathom.operators.neighbours import Space, nearest_rows
from fathom.operators.ordering import running_totals, split_points
from fathom.operators.prep import NeighbourImpute, best_powers, smote
from fathom.plans.views import working_table

from fathom.catalog.fixed_models import fixed_model
from fathom.sources.tables import read_jdbc


@pytest.mark.parametrize("scale", [1e-9, 1.0, 2e14])
def test_imputed_means_keep_their_digits(spark, scale):
    rows = [(i, float(i), scale * (i + 1)) for i in range(5)] + [(9, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, u double, v double")
    model = NeighbourImpute(key="id", exclude=["id"]).fit(df)
    value = model.transform(df).where("id = 9").first().v
    assert value == pytest.approx(3 * scale, rel=1e-12)


def test_rows_with_one_key_are_imputed_on_their_own(spark):
    donors = [(i, float(i % 2) * 100 + i * 0.01, float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(donors + [(50, 0.0, None), (50, 100.0, None)], "id long, u double, v double")
    filled = NeighbourImpute(key="id", exclude=["id"]).fit(df).transform(df).where("id = 50").collect()
    assert sorted((r.u, r.v) for r in filled) == [(0.0, 0.0), (100.0, 1.0)]


def test_missing_truths_are_no_errors(spark):
    df = spark.createDataFrame(
        [("x", "a", "a", 0.9), ("x", "b", "b", 0.9), ("x", None, "a", None), (None, "a", "b", 0.1), (None, "b", "b", 0.9)],
        "g string, t string, p string, chance double",
    )
    found = {(r.g, r.metric): r.value for r in class_metrics(df, "t", "p", ["g"], "chance").collect()}
    assert found["x", "accuracy"] == 1.0 and found["x", "sensitivity"] == 1.0 and found["x", "mn_log_loss"] == pytest.approx(0.10536, abs=1e-4)
    assert found[None, "accuracy"] == 0.5 and found[None, "sensitivity"] == 0.5 and found[None, "specificity"] == 0.5


def test_oversampling_reaches_its_goal_with_missing_numbers(spark):
    rows = [(i, "big", float(i)) for i in range(40)] + [(100 + i, "small", float(i) if i < 4 else None) for i in range(10)]
    grown = smote(spark.createDataFrame(rows, "id long, class string, u double"), "class", "id")
    assert {r["class"]: r["count"] for r in grown.groupBy("class").count().collect()} == {"big": 40, "small": 40}
    none = [(i, "big", float(i)) for i in range(9)] + [(100 + i, "small", None) for i in range(3)]
    with pytest.raises(ValueError, match="no row has a neighbour"):
        smote(spark.createDataFrame(none, "id long, class string, u double"), "class", "id")


def test_many_classes_and_cells(spark):
    rows = [(i, f"c{i % 400}", float(i)) for i in range(1200)] + [(5000 + i, "big", float(i)) for i in range(5)]
    grown = smote(spark.createDataFrame(rows, "id long, class string, u double"), "class", "id", neighbours=2)
    assert {r["count"] for r in grown.groupBy("class").count().collect()} == {5}
    points = spark.createDataFrame([(i, float(i)) for i in range(3000)], "id long, u double")
    asked = points.where("id % 500 = 7")
    near = nearest_rows(asked, points, "id", Space(["u"], [], {"u": 2999.0}), 2, cell_rows=3)
    found = {}
    for r in near.collect():
        found.setdefault(int(r.id), set()).add(int(r.donor))
    assert found == {i: {i - 1, i + 1} for i in range(7, 3000, 500)}


def test_columns_of_few_values_keep_their_scale(spark):
    rows = [(float(i % 2) * 50, float(i % 4), float(i) ** 3) for i in range(60)]
    found = best_powers(spark.createDataFrame(rows, "two double, four double, many double"), ["two", "four", "many"])
    assert list(found) == ["many"] and 0 < found["many"] < 1


def test_shared_values_leave_a_hot_group_its_ranges(spark):
    shared = spark.range(20000 * 50).selectExpr("id % 20000 AS g", "id DIV 20000 AS v")
    hot = spark.range(5000).selectExpr("-1L AS g", "id + 1000 AS v")
    df = shared.unionByName(hot).selectExpr("g", "v", "1L AS n")
    points = split_points(df, "v", 32, ["g"])
    assert len(points) >= 3  # the hot group has one row in 200 here
    alone = split_points(hot, "v", 32, ["g"])
    assert len(alone) == 31
    few = spark.createDataFrame([(1, v) for v in range(4000)] + [(g, v) for g in range(2, 90) for v in range(50)], "g long, v long")
    assert len(split_points(few, "v", 32, ["g"])) >= 16
    totals = running_totals(few.selectExpr("g", "v", "1L AS n"), ["g"], "v", ["n"]).where("g = 1 AND v = 3999").first()
    assert totals.cum_n == 4000 and totals.all_n == 4000


def test_working_table_keeps_all_rows_unless_told(spark):
    rows = [("s", f"t{i}", float(i), None) for i in range(9)]
    df = spark.createDataFrame(rows, "biosample_id string, taxon_name string, fraction_total_reads double, temperature double")
    assert working_table(df).count() == 9 and working_table(df, 4).count() == 4
    assert working_table(df).where("temperature IS NULL").count() == 0


def test_explaining_nothing_gives_nothing(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0, 3.0)], "id string, a double, b double, c double")
    assert break_down(fixed_model(), df, df.where("id = 'z'"), ["a", "b", "c"], "id").count() == 0
    assert quantile_grids(df.where("id = 'z'"), ["a"]) == {"a": []}


def test_relational_tables_are_read_in_parts(spark):
    with pytest.raises(ValueError, match="in parts"):
        read_jdbc(spark, "jdbc:none", "t")
    with pytest.raises(ValueError, match="in parts"):
        read_jdbc(spark, "jdbc:none", "t", partition_column="id")
