"""Missing values, ties, empty input, duplicates: tiny literal tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from fathom.functions.columns import pull
from fathom.functions.numbers import (
    count_distinct_na, exact_avg, na_propagating, nan_to_null, number_text, percent_text, round_half_up, sign_label,
)
from fathom.functions.text import clean_names, date_part, first_match, subject_matches, truncate_text
from fathom.operators.chartdata import box_statistics, density, histograms
from fathom.operators.filters import FilterSpec, apply_filters, default_bounds, keep_members
from fathom.operators.joins import left_join, left_join_many, natural_left_join
from fathom.operators.metrics import gain_lift, leaderboard_long, roc_auc, threshold_table
from fathom.operators.ordering import dense_codes, exact_quantiles, hashed_rank, running_totals
from fathom.operators.profile import column_summary, correlations, missing_profile, skewness_profile
from fathom.operators.rank import first_of_ties, group_maximum, share_within, top_n_with_ties
from fathom.operators.reshape import bind_rows, lengthen, nest, one_wide_row, unnest, widen
from fathom.plans.views import column_to_string, link_rules


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame(
        [("a", "p", 3.0), ("a", "q", 3.0), ("a", "r", 1.0), ("b", "p", None), ("b", "q", 2.0)], "g string, k string, x double"
    )


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")


def test_top_n_keeps_ties_and_ranks_missing_last(ties):
    assert [r[1] for r in rows(top_n_with_ties(ties, ["g"], "x", 1))] == ["p", "q", "q"]
    assert len(rows(top_n_with_ties(ties, ["g"], "x", 2))) == 4
    assert len(rows(top_n_with_ties(ties, ["g"], "x", 3))) == 5


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_large_n_agrees_with_small_n(ties, monkeypatch, n):
    small = rows(top_n_with_ties(ties, ["g"], "x", n))
    monkeypatch.setattr("fathom.operators.rank.GROUP_LIMIT_THRESHOLD", 0)
    assert rows(top_n_with_ties(ties, ["g"], "x", n)) == small


def test_group_maximum_ignores_missing(ties):
    assert [(r[0], r[1]) for r in rows(group_maximum(ties, ["g"], "x"))] == [("a", "p"), ("a", "q"), ("b", "q")]


def test_first_of_ties(ties):
    kept = rows(first_of_ties(ties.where("g = 'a'"), "x", "k"))
    assert [r[1] for r in kept] == ["p", "r"]


def test_shares_add_up_to_one(ties):
    shares = share_within(ties, ["g"], "k", scale=1.0).groupBy("g").agg(F.sum("percent").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in shares)


def test_distinct_count_counts_missing(numbers):
    assert numbers.agg(count_distinct_na("x")).first()[0] == 3
    assert numbers.limit(0).agg(count_distinct_na("x")).first()[0] == 0


def test_na_propagation(numbers):
    row = numbers.agg(F.max("x").alias("a"), na_propagating(F.max("x"), "x", True).alias("b")).first()
    assert (row.a, row.b) == (3.0, None)


def test_empty_profiles(numbers):
    empty = numbers.limit(0)
    row = missing_profile(empty).first()
    assert (row.num_missing, row.pct_missing) == (0, None)
    assert skewness_profile(empty).first().value is None
    assert exact_avg_of(empty) is None


def exact_avg_of(df):
    return df.agg(exact_avg("x")).first()[0]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0, "u"), (1.0, 2.0, "u")], "a double, b double, c string")
    assert {r.feature: r.correlation for r in correlations(df, "b").collect()} == {"a": None, "c": None}


def test_text_correlation_uses_alphabetical_codes(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0), (None, 9.0), ("y", None)], "c string, y double")
    assert abs(correlations(df, "y").first().correlation - 1.0) < 1e-12


def test_widen_fills_absent_cells_only(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", None), (2, "a", 7.0)], "id int, k string, v double")
    assert rows(widen(df, "k", "v", fill=0.0)) == [(1, 5.0, None), (2, 7.0, 0.0)]


def test_widen_refuses_two_values_in_a_cell(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", 6.0)], "id int, k string, v double")
    with pytest.raises(Exception, match="more than one value for a"):
        widen(df, "k", "v").collect()


def test_lengthen_undoes_widen(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 6.0), (2, "a", 7.0), (2, "b", 8.0)], "id int, k string, v double")
    assert rows(lengthen(widen(df, "k", "v"), ["a", "b"], "k", "v")) == rows(df)


def test_bind_rows_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "t")], "x int, y string")
    assert rows(bind_rows(a, b)) == [(1, None), (2, "t")]


def test_nest_then_unnest(ties):
    assert rows(unnest(nest(ties, ["g"]))) == rows(ties)


def test_one_wide_row(ties):
    assert rows(one_wide_row(ties, "k")) == [("p", "q", "r")]


def test_clean_names():
    assert clean_names(["Total Reads", "total.reads", "C13.5/A13.5", "FeT_darwin_clim", "NO3_darwin_clim", "a#b", "7 days"]) == [
        "total_reads", "total_reads_2", "c13_5_a13_5", "fe_t_darwin_clim", "no3_darwin_clim", "a_number_b", "x7_days",
    ]


def test_truncated_text(spark):
    df = spark.createDataFrame([("Prochloraceae",), ("abcdefghijklmnop",), ("abcdefghijklmnopq",), (None,)], "t string")
    assert [r[0] for r in df.select(truncate_text("t", 16)).collect()] == [
        "Prochloraceae", "abcdefghijklmnop", "abcdefghijklm...", None,
    ]


def test_bad_dates_are_missing(spark):
    df = spark.createDataFrame([("2016-03-27T10:00:00Z",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(date_part("t")).collect()] == [datetime.date(2016, 3, 27), None, None]


def test_first_match_reads_dots_as_wildcards(spark):
    df = spark.createDataFrame([("C13.5/A13.5",), ("other",), (None,)], "s string")
    found = [r[0] for r in df.select(first_match("s", link_rules())).collect()]
    assert found[0].endswith(">C13.5/A13.5</a>") and found[1:] == ["other", None]


def test_subject_matches(spark):
    df = spark.createDataFrame([("Prochloraceae",), ("Prochl",), ("Other",), (None,)], "p string")
    assert [r[0] for r in df.select(subject_matches("Prochloraceae", "p")).collect()] == [True, True, False, None]


def test_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.675,), (None,), (1e300,)], "x double")
    assert [r[0] for r in df.select(round_half_up("x", 0)).collect()] == [1.0, 2.0, 3.0, 0.0, 3.0, None, 1e300]


def test_number_text(spark):
    df = spark.createDataFrame([(12.0,), (0.1234,), (0.5,), (100.0,), (None,)], "x double")
    assert [r[0] for r in df.select(number_text("x", 2)).collect()] == ["12", "0.12", "0.5", "100", None]
    assert df.select(percent_text("x")).collect()[1][0] == "12.34"


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(nan_to_null("x")).collect()] == [None, 1.0]
    assert missing_profile(df).first().num_missing == 1


def test_missing_sign_is_negative(numbers):
    assert [r[0] for r in numbers.select(sign_label("x")).collect()] == ["Positive", "Negative", "Positive"]


def test_null_keys_match_only_when_asked(spark):
    left = spark.createDataFrame([(1, "l1"), (None, "l2")], "k int, a string")
    right = spark.createDataFrame([(1, "r1"), (None, "r2")], "k int, b string")
    assert rows(left_join(left, right, ["k"])) == [(1, "l1", "r1"), (None, "l2", None)]
    assert rows(left_join(left, right, ["k"], null_safe=True)) == [(1, "l1", "r1"), (None, "l2", "r2")]
    assert rows(natural_left_join(left, right)) == rows(left_join(left, right, ["k"]))


def test_join_to_many_keeps_lonely_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "j int, b string")
    assert rows(left_join_many(left, right, {"k": "j"})) == [(1, "a"), (1, "b"), (2, None), (None, None)]


def test_join_suffix(spark):
    left = spark.createDataFrame([(1, 5)], "k int, v int")
    right = spark.createDataFrame([(1, 6)], "k int, v int")
    assert left_join(left, right, ["k"], suffix="_there").columns == ["k", "v", "v_there"]


def test_filter_drops_missing_and_long_lists_become_joins(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "section_id string, depth double")
    assert rows(apply_filters(df, FilterSpec(depth=(0, 2)))) == [("a", 1.0)]
    monkeypatch.setattr("fathom.operators.filters.LITERAL_LIST_LIMIT", 1)
    assert rows(apply_filters(df, FilterSpec(sections=["a", "b"])).select("section_id")) == [("a",), ("b",)]
    assert rows(keep_members(df, "section_id", ["c", "c"]).select("section_id")) == [("c",)]


def test_whole_percent_bounds_may_leave_out_the_maximum(spark):
    df = spark.createDataFrame(
        [(datetime.date(2020, 1, 1), 0.123, 1.0, 2.0)],
        "col_date date, fraction_total_reads double, depth double, temperature double",
    )
    assert default_bounds(df).first().reads_percent_max == pytest.approx(12.3)
    assert default_bounds(df, reference_bounds=True).first().reads_percent_max == 12.0


def test_column_to_string_orders_and_strips(spark):
    df = spark.createDataFrame([("g", "b, x", 1.0), ("g", "a", 2.0), ("g", "c", 2.0)], "g string, t string, v double")
    assert column_to_string(df, "g", "t", "v", "t").first().col2string == "a\nc\nbx\n"


def test_pull_is_bounded(ties):
    assert pull(ties, "k") == ["p", "q", "r"]
    with pytest.raises(ValueError):
        pull(ties, "k", limit=2)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, "a"), (10.0, "b"), (None, None)], "x double, c string")
    assert rows(histograms(df)) == [("c", 0, 1), ("c", 9, 1), ("x", 0, 1), ("x", 9, 1)]
    flat = spark.createDataFrame([(5.0, "a"), (5.0, "a"), (None, "a")], "x double, c string")
    assert rows(histograms(flat)) == [("c", 0, 3), ("x", 0, 2)]


def test_box_statistics_with_outlier(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)] + [(None, 1.0)], "g string, v double")
    found = {r.g: r for r in box_statistics(df, ["g"], "v").collect()}
    assert (found["g"].lower, found["g"].median, found["g"].upper) == (2.0, 3.0, 4.0)
    assert (found["g"].whisker_low, found["g"].whisker_high, found["g"].outliers) == (1.0, 4.0, 1)
    assert found[None].n == 1


def test_density_integrates_to_about_one(spark):
    df = spark.range(400).selectExpr("'f' AS f", "'g' AS g", "sin(id) * 10 AS v")
    points = density(df, "f", "g", "v", points=128).orderBy("x").collect()
    width = points[1].x - points[0].x
    assert 0.8 < sum(p.density for p in points) * width < 1.02
    assert density(df.limit(1), "f", "g", "v").count() == 0


def test_column_summary_of_mixed_types(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "a")], "x double, c string")
    found = {r.feature: r for r in column_summary(df).collect()}
    assert (found["x"].p50, found["x"].n_distinct, found["c"].n_distinct, found["c"].num_missing) == (1.5, 2, 1, 1)


def test_one_class_gives_no_rates_instead_of_errors(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 1, 0.2)], "model_id string, truth int, score double")
    assert roc_auc(df, ["model_id"]).first().auc is None
    assert all(r.fpr is None for r in threshold_table(df, ["model_id"]).collect())


def test_tied_scores_stay_together(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "truth int, score double").withColumn("model_id", F.lit("m"))
    assert roc_auc(df, ["model_id"]).first().auc == 0.875
    assert [r.threshold for r in threshold_table(df, ["model_id"]).orderBy("threshold").collect()] == [0.1, 0.8, 0.9]
    last = gain_lift(df, ["model_id"], 4).orderBy(F.col("group").desc()).first()
    assert (last.cumulative_data_fraction, last.cumulative_capture_rate, last.cumulative_lift) == (1.0, 1.0, 1.0)


def test_unknown_metrics_are_refused(spark):
    board = spark.createDataFrame([("GBM_1", 0.9)], "model_id string, auc double")
    with pytest.raises(ValueError):
        leaderboard_long(board, "accuracy")
    with pytest.raises(ValueError):
        leaderboard_long(board, "auc", metrics=["logloss"])


def test_ordering_helpers_do_not_depend_on_partitioning(spark):
    base = spark.range(1000).selectExpr("id", "id % 3 AS g", "CAST(pmod(id * 37, 101) AS DOUBLE) AS v")
    results = []
    for parts in (1, 7):
        df = base.repartition(parts)
        ranks = rows(hashed_rank(df, "id", ["g"], seed=5))
        totals = df.groupBy("g", "v").count()
        cumulated = rows(running_totals(totals, ["g"], "v", ["count"]))
        quartiles = rows(exact_quantiles(df, ["g"], "v", {"q": 0.25, "h": 0.5}))
        codes = rows(dense_codes(df.selectExpr("CAST(v AS STRING) AS t"), [], "t"))
        results.append((ranks, cumulated, quartiles, codes))
    assert results[0] == results[1]
    ranks = results[0][0]
    for g in range(3):
        assert sorted(r[3] for r in ranks if r[1] == g) == list(range(1, sum(1 for r in ranks if r[1] == g) + 1))


def test_one_hot_group_does_not_change_ranks(spark):
    hot = spark.range(3000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id ELSE -1 END AS g", "CAST(id % 17 AS DOUBLE) AS v")
    found = {r.g: r for r in exact_quantiles(hot, ["g"], "v", {"m": 0.5}).collect()}
    values = sorted(float(i % 17) for i in range(3000) if i % 10)
    assert found[-1].n == len(values)
    middle = (len(values) - 1) / 2
    assert found[-1].m == pytest.approx((values[int(middle)] + values[-(-len(values) // 2) if middle % 1 else int(middle)]) / 2)


def test_many_columns_take_the_long_way_with_the_same_result(spark, monkeypatch):
    df = spark.range(50).selectExpr("sin(id) AS a", "id * id AS b", "CASE WHEN id % 5 > 0 THEN cos(id) END AS c", "id AS y")
    wide = rows(correlations(df, "y")) + rows(skewness_profile(df)) + rows(column_summary(df))
    monkeypatch.setattr("fathom.operators.profile.WIDE_LIMIT", 0)
    long = rows(correlations(df, "y")) + rows(skewness_profile(df)) + rows(column_summary(df))
    assert [r[0] for r in wide] == [r[0] for r in long]
    for a, b in zip(wide, long):
        assert [v if not isinstance(v, float) else pytest.approx(v, abs=1e-9) for v in a] == list(b)
