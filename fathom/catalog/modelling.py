"""Splits, models, metrics, explanation, streaming."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..operators.explain import (
    accumulated_dependence, break_down, explained, importance_summary, partial_dependence, permutation_importance,
    residuals_by_feature, row_profiles, shapley,
)
from ..operators.fold_recipe import fit_fold_recipe
from ..operators.metrics import (
    binary_leaderboard, class_metrics, confusion, gain_lift, leaderboard_long, multiclass_auc, performance_pack,
    regression_metrics, roc_auc, roc_curves, threshold_table,
)
from ..operators.models import (
    PREDICTED, bagged_trees, boosted_trees, compare_resampling, fit_prepared, fit_resamples, fold_figures, load_model,
    logistic_formula, model_recipe, save_model, score, score_long, scoring_rows, search, with_label,
)
from ..operators.penalty import lasso_path, lasso_violations
from ..operators.resample import (
    labelled_splits, penalty_grid, random_split, select_best, select_by_one_std_err, summarise_metrics, with_folds,
    with_spatial_folds, with_split, with_stratified_split,
)
from ..operators.reshape import bind_rows
from ..plans.training import train_classification, train_regression
from ..session import materialise, new_path
from ..streaming.scoring import arriving, score_stream
from .preparation import class_table, rows
from .registry import query, rounded

HASH_SQL = "(({key} % 1000003) * (2654435761 % 1000003) + 1234) % 1000003"

# --- splits ------------------------------------------------------------------------------------


@query(
    "c1_random_split",
    f"SELECT o_orderkey, CASE WHEN {HASH_SQL.format(key='o_orderkey')} < 850002 THEN 'train' ELSE 'test' END AS split FROM orders",
)
def _(ws):
    return with_split(ws["orders"].select("o_orderkey"), "o_orderkey", 0.85, method="arithmetic")


@query(
    "c2_stratified_split",
    "SELECT o_orderkey, o_orderpriority, CASE WHEN r <= FLOOR(n * 0.75 + 0.5) THEN 'train' ELSE 'test' END AS split FROM "
    f"(SELECT o_orderkey, o_orderpriority, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY {HASH_SQL.format(key='o_orderkey')}, o_orderkey) AS r, "
    "COUNT(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) x",
)
def _(ws):
    df = ws["orders"].select("o_orderkey", "o_orderpriority")
    return with_stratified_split(df, "o_orderpriority", "o_orderkey", 0.75, method="arithmetic")


@query(
    "c3_stratified_folds",
    "SELECT o_orderkey, o_orderstatus, CAST((r - 1) % 5 AS INTEGER) AS fold FROM "
    f"(SELECT o_orderkey, o_orderstatus, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {HASH_SQL.format(key='o_orderkey')}, o_orderkey) AS r FROM orders) x",
)
def _(ws):
    df = ws["orders"].select("o_orderkey", "o_orderstatus")
    return with_folds(df, "o_orderkey", 5, strata="o_orderstatus", method="arithmetic")


@query("c4_spatial_folds")
def _(ws):
    return with_spatial_folds(rows(ws).select("library_id", "lat", "lon"), "library_id", v=10)


@query(
    "c5_labelled_splits",
    "SELECT c_custkey, fold, CAST(split_id AS INTEGER) AS split_id, CASE WHEN fold = split_id THEN 'Assessment' ELSE 'Analysis' END AS part FROM "
    f"(SELECT c_custkey, CAST((ROW_NUMBER() OVER (ORDER BY {HASH_SQL.format(key='c_custkey')}, c_custkey) - 1) % 4 AS INTEGER) AS fold FROM customer) x, "
    "(SELECT UNNEST(RANGE(0, 4)) AS split_id) s",
)
def _(ws):
    folded = with_folds(ws["customer"].select("c_custkey"), "c_custkey", 4, method="arithmetic")
    return labelled_splits(folded, 4)


TEXT_FEATURES = ["n_chars", "quality", "n_words", "n_lines"]


def documents(ws):
    """Labelled documents with plain numeric features."""
    def build():
        joined = ws["labels"].join(ws["documents"], "doc_id")
        words = F.size(F.split("text", r"\s+")).cast("double")
        lines = F.size(F.split("text", "\n")).cast("double")
        return materialise(
            joined.select(
                "doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("class"), "lang",
                F.col("n_chars").cast("double").alias("n_chars"), F.col("quality").cast("double").alias("quality"),
                words.alias("n_words"), lines.alias("n_lines"),
            ),
            "documents",
        )

    return ws.keep("documents", build)


CLASSES = ["clean", "toxic"]
FOLDS = 10


def _resampled(ws, spatial: bool):
    df = with_label(documents(ws), "class", CLASSES)
    folded = (
        with_spatial_folds(df, "doc_id", ["n_chars", "n_lines"], v=FOLDS) if spatial
        else with_folds(df, "doc_id", FOLDS, strata="class")
    )
    recipe = lambda: model_recipe(LogisticRegression(regParam=0.01), TEXT_FEATURES, "class", CLASSES)
    return fit_resamples(materialise(folded, "folds"), recipe, "class", CLASSES, FOLDS, "doc_id")


@query("c6_fit_resamples")
def _(ws):
    return summarise_metrics(ws.keep("resamples_random", lambda: _resampled(ws, False)))


# Rows of the recipe inside folds: numbers with gaps, and categories that are rare in some folds.
GAPS_SQL = (
    f"(SELECT *, CAST((ROW_NUMBER() OVER (PARTITION BY class ORDER BY {HASH_SQL.format(key='doc_id')}, doc_id) - 1) % 10 AS INTEGER) AS fold FROM "
    "(SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS class, d.lang, d.source, "
    "CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(d.n_chars AS DOUBLE) END AS n_chars, CAST(l.quality AS DOUBLE) AS quality "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id) g)"
)


def _fold_recipe(ws):
    def build():
        known = ws["labels"].join(ws["documents"], "doc_id").select(
            "doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("class"), "lang", "source",
            F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).alias("n_chars"),
            F.col("quality").cast("double").alias("quality"),
        )
        folded = materialise(with_folds(known, "doc_id", FOLDS, strata="class", method="arithmetic"), "folds")
        return folded, fit_fold_recipe(folded, "class", "doc_id", ["n_chars", "quality"], ["lang", "source"], FOLDS, threshold=0.05)

    return ws.keep("fold_recipe", build)


@query(
    "c6_fold_statistics",
    f"WITH g AS (SELECT * FROM {GAPS_SQL} x), s AS (SELECT CAST(UNNEST(RANGE(0, 10)) AS INTEGER) AS split_id), t AS (SELECT * FROM s, g WHERE fold <> split_id), "
    "levels AS (SELECT split_id, feature, value, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY split_id, feature) AS total FROM "
    "(SELECT split_id, 'lang' AS feature, lang AS value FROM t UNION ALL SELECT split_id, 'source', source FROM t) y WHERE value IS NOT NULL GROUP BY split_id, feature, value) "
    + " UNION ALL ".join(
        f"SELECT split_id, '{c}' AS feature, {rounded(f'AVG({c})', 6)} AS mean, {rounded(f'STDDEV_SAMP({c})', 6)} AS deviation, CAST(NULL AS VARCHAR) AS levels FROM t GROUP BY split_id"
        for c in ("n_chars", "quality")
    )
    + " UNION ALL SELECT split_id, feature, NULL, NULL, COALESCE(STRING_AGG(value, ',' ORDER BY value) FILTER (n >= 0.05 * total), '') FROM levels GROUP BY split_id, feature",
)
def _(ws):
    """What the training rows of each fold say, without a pass per fold."""
    _, recipe = _fold_recipe(ws)
    return recipe.statistics(ws.spark).withColumns({c: round_half_up(c, 6) for c in ("mean", "deviation")})


def _balanced(ws):
    def build():
        folded, recipe = _fold_recipe(ws)
        return materialise(recipe.balanced(folded), "balanced")

    return ws.keep("balanced", build)


@query(
    "c6_balanced",
    f"WITH g AS (SELECT * FROM {GAPS_SQL} x), s AS (SELECT CAST(UNNEST(RANGE(0, 10)) AS INTEGER) AS split_id), "
    "n AS (SELECT split_id, class, COUNT(*) FILTER (fold <> split_id) AS own, COUNT(*) FILTER (fold = split_id) AS held FROM s, g GROUP BY split_id, class) "
    "SELECT split_id, class, 'Analysis' AS part, MAX(own) OVER (PARTITION BY split_id) AS n, MAX(own) OVER (PARTITION BY split_id) - own AS n_synthetic, own AS n_keys FROM n "
    "UNION ALL SELECT split_id, class, 'Assessment', held, 0, held FROM n WHERE held > 0",
)
def _(ws):
    """Rows of each class in the parts of each fold: training rows are balanced, assessment rows untouched."""
    real = F.when(~F.col("synthetic"), F.col("doc_id"))
    return _balanced(ws).groupBy("split_id", "class", "part").agg(
        F.count("*").alias("n"), F.count_if("synthetic").alias("n_synthetic"), F.count_distinct(real).alias("n_keys")
    )


@query("c6_fit_balanced")
def _(ws):
    """Bagged trees over ten folds, trained on balanced rows and assessed on rows as they are."""
    _, recipe = _fold_recipe(ws)
    ready = materialise(with_label(_balanced(ws), "class", CLASSES), "balanced-labels")
    trees = lambda: model_recipe(bagged_trees(), recipe.features, "class", CLASSES)
    return summarise_metrics(fit_prepared(ready, trees, "class", CLASSES, FOLDS, "doc_id"))


@query("c7_compare_resampling")
def _(ws):
    return compare_resampling(
        ws.keep("resamples_random", lambda: _resampled(ws, False)), ws.keep("resamples_spatial", lambda: _resampled(ws, True))
    )


# 20 penalties from 1e-5 to 1, for more than two classes.
PENALTIES = penalty_grid(-5, 0, 20)
GRID_SQL = "(SELECT k + 1 AS level, POWER(10.0::DOUBLE, -5 + 5.0::DOUBLE * k / 19) AS penalty FROM (SELECT UNNEST(RANGE(0, 20)) AS k) r)"
FOLDED_SQL = (
    f"(SELECT d.doc_id, lang, CAST((ROW_NUMBER() OVER (PARTITION BY lang ORDER BY {HASH_SQL.format(key='d.doc_id')}, d.doc_id) - 1) % {FOLDS} AS INTEGER) AS fold "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)


def _languages(ws):
    return ws.keep("languages", lambda: sorted(r.lang for r in documents(ws).select("lang").where("lang IS NOT NULL").distinct().collect()))


def _language_folds(ws):
    return ws.keep(
        "language_folds",
        lambda: materialise(with_folds(documents(ws), "doc_id", FOLDS, strata="lang", method="arithmetic"), "folds"),
    )


@query(
    "c8_penalty_grid",
    f"SELECT CAST(level AS INTEGER) AS level, {rounded('penalty', 9)} AS penalty, fold, CAST(SUM(n) OVER (PARTITION BY level) - n AS BIGINT) AS n_train, n AS n_held "
    f"FROM {GRID_SQL} g, (SELECT fold, COUNT(*) AS n FROM {FOLDED_SQL} x GROUP BY fold) f",
)
def _(ws):
    """The fits that tuning makes: every penalty of the grid with every fold, and the rows they see."""
    grid = F.array(*[F.struct(F.lit(k + 1).alias("level"), F.lit(p).alias("penalty")) for k, p in enumerate(PENALTIES)])
    folded = _language_folds(ws)
    sizes = folded.groupBy("fold").agg(F.count("*").alias("n_held")).withColumn("all", F.lit(folded.count()))
    fits = sizes.select("*", F.inline(grid))
    return fits.select("level", round_half_up("penalty", 9).alias("penalty"), "fold", (F.col("all") - F.col("n_held")).alias("n_train"), "n_held")


def _path(ws):
    return ws.keep("path", lambda: lasso_path(_language_folds(ws), TEXT_FEATURES, "lang", _languages(ws), PENALTIES, "fold", FOLDS))


def _tuned(ws):
    def build():
        predicted = _path(ws).predict(_language_folds(ws), ["fold", "doc_id", "lang"], fold="fold")
        by_fold = fold_figures(materialise(predicted, "tuning"), "lang", _languages(ws), ["penalty", "fold"])
        return materialise(summarise_metrics(by_fold, ["penalty"]), "tuned")

    return ws.keep("tuned", build)


@query("c9_tune_grid")
def _(ws):
    return _tuned(ws)


@query(
    "c9_holdout_rows",
    f"SELECT doc_id, lang, fold, {rounded('penalty', 9)} AS penalty, TRUE AS known, 1.0::DOUBLE AS total FROM {FOLDED_SQL} x, {GRID_SQL} g",
)
def _(ws):
    """Every labelled row once for each penalty, predicted by the models that held it out."""
    predicted = _path(ws).predict(_language_folds(ws), ["doc_id", "lang", "fold"], fold="fold")
    chances = [F.col(f"p_{v}") for v in _languages(ws)]
    known = F.col(PREDICTED).isin(_languages(ws))
    return predicted.select(
        "doc_id", "lang", "fold", round_half_up("penalty", 9).alias("penalty"), known.alias("known"),
        round_half_up(reduce(add, chances), 9).alias("total"),
    )


@query(
    "l5_lasso_optimality",
    f"SELECT {rounded('penalty', 9)} AS penalty, lang AS class, TRUE AS optimal FROM {GRID_SQL} g, "
    "(SELECT DISTINCT lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id) c",
)
def _(ws):
    """Whether the gradient of the likelihood is what the penalty allows, at every penalty, for every class."""
    violations = lasso_violations(_path(ws), documents(ws), "lang")
    worst = violations.groupBy("penalty", "class").agg(F.max("violation").alias("worst"))
    return worst.select(round_half_up("penalty", 9).alias("penalty"), "class", (F.col("worst") < 2e-4).alias("optimal"))


@query("c10_choose_penalty")
def _(ws):
    best = select_best(_tuned(ws), "roc_auc").withColumn("rule", F.lit("best"))
    return best.unionByName(select_by_one_std_err(_tuned(ws), "roc_auc").withColumn("rule", F.lit("one standard error")))


@query("c11_last_fit")
def _(ws):
    penalty = select_by_one_std_err(_tuned(ws), "roc_auc").first().penalty
    split = with_stratified_split(documents(ws), "lang", "doc_id")
    train, test = (split.where(F.col("split") == part) for part in ("train", "test"))
    path = lasso_path(train, TEXT_FEATURES, "lang", _languages(ws), [penalty])
    predicted = materialise(path.predict(test, ["doc_id", "lang"]), "last-fit")
    return fold_figures(predicted, "lang", _languages(ws), [])


# --- models ------------------------------------------------------------------------------------

INPUTS = ["lat", "section_id_AMT28", "section_id_P18", "dop_darwin_clim"]


def observations(ws):
    """Samples with a temperature and the four inputs of the scoring service."""
    def build():
        flag = lambda s: (F.col("section_id") == s).cast("double").alias(f"section_id_{s}")
        return materialise(
            rows(ws).select(
                "library_id", "lat", flag("AMT28"), flag("P18"), F.col("dop").alias("dop_darwin_clim"), "temperature"
            ),
            "observations",
        )

    return ws.keep("observations", build)


def known_rows(ws):
    return observations(ws).where(F.col("temperature").isNotNull())


def regressor(ws):
    recipe = model_recipe(RandomForestRegressor(numTrees=10, maxDepth=5, seed=1), INPUTS, "temperature")
    return ws.keep("regressor", lambda: recipe.fit(random_split(known_rows(ws), "library_id")[0]))


def small_regressors():
    return {
        "GLM_1": lambda: LinearRegression(regParam=0.01),
        "DRF_1": lambda: RandomForestRegressor(numTrees=10, maxDepth=5, seed=1),
        "GBM_1": lambda: GBTRegressor(maxIter=5, maxDepth=3, seed=1),
    }


def small_classifiers():
    return {
        "GLM_1": lambda: LogisticRegression(regParam=0.01),
        "DRF_1": lambda: RandomForestClassifier(numTrees=10, maxDepth=5, seed=1),
    }


def _regression_search(ws):
    return ws.keep(
        "regression_search",
        lambda: search(known_rows(ws), "temperature", INPUTS, "library_id", nfolds=3, candidates=small_regressors()),
    )


def _class_search(ws):
    def build():
        train, test = random_split(documents(ws), "doc_id")
        return search(
            train, "class", TEXT_FEATURES, "doc_id", nfolds=3, candidates=small_classifiers(), leaderboard_frame=test
        )

    return ws.keep("class_search", build)


@query("l1_search_regression")
def _(ws):
    return _regression_search(ws).leaderboard


@query("l2_search_classification")
def _(ws):
    return _class_search(ws).leaderboard


@query("l2_search_multiclass")
def _(ws):
    found = search(documents(ws), "lang", TEXT_FEATURES, "doc_id", nfolds=2, candidates=small_classifiers())
    return found.leaderboard


@query("l3_leader")
def _(ws):
    found = _regression_search(ws)
    return found.leader.transform(known_rows(ws)).withColumn("model_id", F.lit(found.name(1)))


@query("l4_logistic")
def _(ws):
    df = documents(ws).withColumn("toxic", (F.col("class") == "toxic").cast("double"))
    model = logistic_formula(df, "toxic ~ n_chars + quality + n_lines")
    return model.transform(df).select("doc_id", "prediction")


@query("l5_multinomial_lasso")
def _(ws):
    path = lasso_path(documents(ws), TEXT_FEATURES, "lang", _languages(ws), [0.01])
    return path.predict(documents(ws), ["doc_id", "lang"]).select("doc_id", "lang", PREDICTED)


@query("l6_bagged_trees")
def _(ws):
    recipe = model_recipe(bagged_trees(), TEXT_FEATURES, "class", CLASSES)
    return recipe.fit(with_label(documents(ws), "class", CLASSES)).transform(documents(ws)).select("doc_id", "class", PREDICTED)


@query("l7_boosted_trees")
def _(ws):
    recipe = model_recipe(boosted_trees(rounds=5), INPUTS, "temperature")
    return recipe.fit(known_rows(ws)).transform(observations(ws)).select("library_id", PREDICTED)


@query("l8_holdout_predictions")
def _(ws):
    return _regression_search(ws).holdout


@query("l9_batch_scoring")
def _(ws):
    return score(regressor(ws), observations(ws))


@query("l10_scoring_rows")
def _(ws):
    defaults = scoring_rows(ws.spark, [(2.37, 0, 0, 2.5)]).withColumn("row_id", F.concat(F.lit("default-"), "row_id"))
    asked = bind_rows(observations(ws).select(F.col("library_id").alias("row_id"), *INPUTS), defaults)
    return score_long(regressor(ws), asked, "row_id", INPUTS)


@query("l11_missing_inputs")
def _(ws):
    return score(regressor(ws), observations(ws).select("library_id", "lat"))


@query("s9_model_store", "SELECT library_id, 0.0::DOUBLE AS difference FROM experiment_metadata")
def _(ws):
    path = new_path(ws.spark, "model")
    save_model(regressor(ws), path)
    first = regressor(ws).transform(observations(ws)).select("library_id", F.col(PREDICTED).alias("a"))
    second = load_model(path).transform(observations(ws)).select("library_id", F.col(PREDICTED).alias("b"))
    return first.join(second, "library_id").select("library_id", F.abs(F.col("a") - F.col("b")).alias("difference"))


@query("p12_beside_inputs", "SELECT library_id, latitude_decimal_deg_n AS lat, TRUE AS predicted FROM experiment_metadata")
def _(ws):
    return score(regressor(ws), observations(ws)).select("library_id", "lat", F.col(PREDICTED).isNotNull().alias("predicted"))


# --- metrics -----------------------------------------------------------------------------------

COUNTS_SQL = """
WITH sc_counts AS (SELECT model_id, score, COUNT(*) AS n, SUM(CASE WHEN truth = 1 THEN 1 ELSE 0 END) AS hits,
                          SUM(CASE WHEN truth = 1 THEN 0 ELSE 1 END) AS misses FROM scored GROUP BY model_id, score),
sc_cum AS (SELECT *, CAST(SUM(n) OVER w AS DOUBLE) AS cn, CAST(SUM(hits) OVER w AS DOUBLE) AS ch, CAST(SUM(misses) OVER w AS DOUBLE) AS cm,
                  CAST(SUM(n) OVER a AS DOUBLE) AS an, CAST(SUM(hits) OVER a AS DOUBLE) AS ah, CAST(SUM(misses) OVER a AS DOUBLE) AS am FROM sc_counts
           WINDOW w AS (PARTITION BY model_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY model_id)),
sc_board AS (SELECT model_id, SUM(hits * (am - cm + misses * 0.5::DOUBLE)) / (MAX(ah) * MAX(am)) AS auc,
   -SUM(hits * LN(LEAST(GREATEST(score, 1e-15), 1 - 1e-15)) + misses * LN(1 - LEAST(GREATEST(score, 1e-15), 1 - 1e-15))) / MAX(an) AS logloss,
   SUM(hits / ah * ch / cn) AS aucpr,
   ARG_MAX(((ah - ch) / ah + cm / am) / 2, ROW(2.0::DOUBLE * ch / (cn + ah), score)) AS mean_per_class_error,
   SUM(hits * POWER(1 - score, 2) + misses * POWER(score, 2)) / MAX(an) AS mse FROM sc_cum GROUP BY model_id),
sc_metrics AS (SELECT model_id, auc, logloss, aucpr, mean_per_class_error, SQRT(mse) AS rmse, mse FROM sc_board)"""

METRICS = ("auc", "logloss", "aucpr", "mean_per_class_error", "rmse", "mse")


def rounded_metrics(table, names=METRICS, digits=6):
    return table.withColumns({m: round_half_up(m, digits) for m in names})


@query("e1_leaderboard_metrics", f"{COUNTS_SQL} SELECT model_id, {', '.join(f'{rounded(m, 6)} AS {m}' for m in METRICS)} FROM sc_metrics")
def _(ws):
    return rounded_metrics(binary_leaderboard(ws["scored"]))


def long_board_sql(metrics, order: str) -> str:
    ranked = f"(SELECT *, ROW_NUMBER() OVER (ORDER BY {order}, model_id) AS rowname FROM sc_metrics)"
    return f"{COUNTS_SQL} " + " UNION ALL ".join(
        f"SELECT rowname, CAST(rowname AS VARCHAR) || '. ' || model_id AS model_id, SPLIT_PART(model_id, '_', 1) AS model_type, '{m}' AS key, {rounded(m, 6)} AS value FROM {ranked} r WHERE rowname <= 20"
        for m in metrics
    )


@query("e2_leaderboard_long", long_board_sql(METRICS, "auc DESC"))
def _(ws):
    return rounded_metrics(leaderboard_long(binary_leaderboard(ws["scored"]), "auc"), ["value"])


@query("e3_leaderboard_chosen", long_board_sql(("rmse", "logloss"), "logloss"))
def _(ws):
    board = leaderboard_long(binary_leaderboard(ws["scored"]), "logloss", metrics=["rmse", "logloss"])
    return rounded_metrics(board, ["value"])


def _guessed(ws):
    return ws["scored"].select(
        "model_id", "truth", (F.col("score") >= 0.5).cast("int").alias("guess"),
        F.when(F.col("truth") == 1, F.col("score")).otherwise(1 - F.col("score")).alias("p"),
    )


GUESS_SQL = "(SELECT model_id, truth, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS guess, CASE WHEN truth = 1 THEN score ELSE 1 - score END AS p FROM scored) g"


@query(
    "e4_class_metrics",
    " UNION ALL ".join(
        f"SELECT model_id, '{name}' AS metric, {rounded(value, 6)} AS value FROM {GUESS_SQL} GROUP BY model_id"
        for name, value in (
            ("accuracy", "CAST(COUNT(*) FILTER (truth = guess) AS DOUBLE) / COUNT(*)"),
            ("mn_log_loss", "AVG(-LN(GREATEST(p, 1e-15)))"),
            (
                "sensitivity",
                "(CAST(COUNT(*) FILTER (truth = 1 AND guess = 1) AS DOUBLE) / COUNT(*) FILTER (truth = 1) + CAST(COUNT(*) FILTER (truth = 0 AND guess = 0) AS DOUBLE) / COUNT(*) FILTER (truth = 0)) / 2",
            ),
            (
                "specificity",
                "(CAST(COUNT(*) FILTER (truth = 0 AND guess = 0) AS DOUBLE) / COUNT(*) FILTER (truth = 0) + CAST(COUNT(*) FILTER (truth = 1 AND guess = 1) AS DOUBLE) / COUNT(*) FILTER (truth = 1)) / 2",
            ),
        )
    ),
)
def _(ws):
    return rounded_metrics(class_metrics(_guessed(ws), "truth", "guess", ["model_id"], "p"), ["value"])


@query("e5_roc_auc", f"{COUNTS_SQL} SELECT model_id, {rounded('auc', 8)} AS auc FROM sc_metrics")
def _(ws):
    return rounded_metrics(roc_auc(ws["scored"], ["model_id"]), ["auc"], 8)


LANGUAGES = {"de": 7, "en": 3, "es": 13, "fr": 11}
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT source, '{level}' AS own, CAST((n_chars * {k}) % 100 AS DOUBLE) / 100 AS score, lang FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')"
    for level, k in LANGUAGES.items()
)


@query(
    "e5_multiclass",
    f"WITH cells AS (SELECT source, own, score, lang, COUNT(*) AS n FROM ({PAIRS_SQL}) c GROUP BY source, own, score, lang), "
    "sizes AS (SELECT source, own, lang, SUM(n) AS n FROM cells GROUP BY source, own, lang), "
    "shares AS (SELECT a.source, a.own, b.lang, CAST(SUM(CASE WHEN a.score > b.score THEN a.n * b.n WHEN a.score = b.score THEN a.n * b.n * 0.5 ELSE 0 END) AS DOUBLE) AS above "
    "FROM cells a JOIN cells b ON a.source IS NOT DISTINCT FROM b.source AND a.own = b.own WHERE a.lang = a.own AND b.lang <> a.own GROUP BY a.source, a.own, b.lang) "
    f"SELECT d.source, {rounded('AVG(s.above / (CAST(a.n AS DOUBLE) * b.n))', 8)} AS auc FROM (SELECT DISTINCT source FROM cells) d "
    "LEFT JOIN shares s ON s.source IS NOT DISTINCT FROM d.source "
    "LEFT JOIN sizes a ON a.source IS NOT DISTINCT FROM s.source AND a.own = s.own AND a.lang = s.own "
    "LEFT JOIN sizes b ON b.source IS NOT DISTINCT FROM s.source AND b.own = s.own AND b.lang = s.lang GROUP BY d.source",
)
def _(ws):
    chance = [(((F.col("n_chars") * k) % 100).cast("double") / 100).alias(f"p_{v}") for v, k in LANGUAGES.items()]
    df = ws["documents"].select("source", "lang", *chance)
    df = df.where(F.col("lang").isin(*LANGUAGES))
    return rounded_metrics(multiclass_auc(df, "lang", {v: f"p_{v}" for v in LANGUAGES}, ["source"]), ["auc"], 8)


RATES = ("tpr", "fpr", "precision", "recall")
THRESHOLD_SQL = (
    "SELECT model_id, score AS threshold, "
    + ", ".join(
        f"{rounded(e, 8)} AS {n}" for n, e in (("tpr", "ch / ah"), ("fpr", "cm / am"), ("precision", "ch / cn"), ("recall", "ch / ah"))
    )
    + " FROM sc_cum"
)


@query("e6_threshold_table", f"{COUNTS_SQL} {THRESHOLD_SQL}")
def _(ws):
    return rounded_metrics(threshold_table(ws["scored"], ["model_id"]), RATES, 8)


GAIN_SQL = (
    'SELECT model_id, CAST(FLOOR((cn - n) * 16 / an) + 1 AS INTEGER) AS "group", '
    + ", ".join(
        f"{rounded(e, 8)} AS {n}"
        for n, e in (
            ("cumulative_data_fraction", "MAX(cn) / MAX(an)"),
            ("cumulative_capture_rate", "MAX(ch) / MAX(ah)"),
            ("cumulative_lift", "(MAX(ch) / MAX(ah)) / (MAX(cn) / MAX(an))"),
        )
    )
    + " FROM sc_cum GROUP BY 1, 2"
)


@query("e7_gain_lift", f"{COUNTS_SQL} {GAIN_SQL}")
def _(ws):
    table = gain_lift(ws["scored"], ["model_id"])
    return rounded_metrics(table, ("cumulative_data_fraction", "cumulative_capture_rate", "cumulative_lift"), 8)


BEST_SQL = f"(SELECT model_id, ROW_NUMBER() OVER (ORDER BY auc DESC, model_id) AS rowname, {rounded('auc', 8)} AS auc FROM sc_metrics)"


@query("e8_performance_thresholds", f"{COUNTS_SQL} SELECT t.*, b.rowname, b.auc FROM ({THRESHOLD_SQL}) t JOIN {BEST_SQL} b ON t.model_id = b.model_id WHERE b.rowname <= 2")
def _(ws):
    thresholds, _ = performance_pack(ws["scored"], "auc", 2)
    return rounded_metrics(thresholds, [*RATES, "auc"], 8)


@query(
    "e8_performance_gains",
    f"{COUNTS_SQL} SELECT t.model_id, t.\"group\", t.cumulative_data_fraction, t.cumulative_capture_rate AS gain, t.cumulative_lift AS lift, b.rowname, b.auc "
    f"FROM ({GAIN_SQL}) t JOIN {BEST_SQL} b ON t.model_id = b.model_id WHERE b.rowname <= 2",
)
def _(ws):
    _, gains = performance_pack(ws["scored"], "auc", 2)
    return rounded_metrics(gains, ["cumulative_data_fraction", "gain", "lift", "auc"], 8)


@query("e9_confusion", f"SELECT model_id, truth, guess, COUNT(*) AS n FROM {GUESS_SQL} GROUP BY model_id, truth, guess")
def _(ws):
    return confusion(_guessed(ws), "truth", "guess", ["model_id"])


CURVE_SQL = " UNION ALL ".join(
    f"SELECT '{level}' AS level, CAST((n_chars * {k}) % 100 AS DOUBLE) / 100 AS score, CASE WHEN lang = '{level}' THEN 1 ELSE 0 END AS truth FROM documents"
    for level, k in (("en", 3), ("de", 7), ("fr", 11))
)


@query(
    "e10_roc_curves",
    f"SELECT level, score AS threshold, {rounded('1 - CAST(SUM(m) OVER w AS DOUBLE) / SUM(m) OVER a', 8)} AS specificity, {rounded('CAST(SUM(h) OVER w AS DOUBLE) / NULLIF(SUM(h) OVER a, 0)', 8)} AS sensitivity FROM "
    f"(SELECT level, score, SUM(truth) AS h, SUM(1 - truth) AS m FROM ({CURVE_SQL}) c GROUP BY level, score) x "
    "WINDOW w AS (PARTITION BY level ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY level)",
)
def _(ws):
    chance = lambda k: ((F.col("n_chars") * k) % 100).cast("double") / 100
    df = ws["documents"].select("lang", chance(3).alias("p_en"), chance(7).alias("p_de"), chance(11).alias("p_fr"))
    curves = roc_curves(df, "lang", {"en": "p_en", "de": "p_de", "fr": "p_fr"})
    return rounded_metrics(curves, ["specificity", "sensitivity"], 8)


@query(
    "e11_regression_metrics",
    "SELECT l_returnflag, "
    + ", ".join(
        f"{rounded(e, 3)} AS {n}"
        for n, e in (
            ("rmse", "SQRT(AVG(POWER(t - p, 2)))"), ("mae", "AVG(ABS(t - p))"), ("r2", "1 - AVG(POWER(t - p, 2)) / VAR_POP(t)"),
        )
    )
    + f", {rounded('AVG(POWER(t - p, 2))', 0)} AS mse FROM (SELECT l_returnflag, l_extendedprice AS t, l_quantity * 1450 AS p FROM lineitem) x GROUP BY l_returnflag",
)
def _(ws):
    df = ws["lineitem"].select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1450).alias("p"))
    table = regression_metrics(df, "l_extendedprice", "p", ["l_returnflag"])
    return rounded_metrics(table, ["rmse", "mae", "r2"], 3).withColumn("mse", round_half_up("mse", 0))


@query("u4_function_per_model", f"SELECT model_id, truth, guess, COUNT(*) AS n FROM {GUESS_SQL} GROUP BY model_id, truth, guess")
def _(ws):
    guessed = _guessed(ws)
    parts = [
        confusion(guessed.where(F.col("model_id") == m), "truth", "guess").withColumn("model_id", F.lit(m))
        for m in ("GBM_1", "GLM_1", "DRF_1")
    ]
    return bind_rows(*parts)


# --- explanation -------------------------------------------------------------------------------


def test_rows(ws):
    return random_split(known_rows(ws), "library_id")[1]


def few(ws, n: int):
    return test_rows(ws).orderBy("library_id").limit(n)


@query("d1_explainer")
def _(ws):
    return explained(regressor(ws), test_rows(ws), "temperature", "library_id", INPUTS)


@query("d2_permutation_importance")
def _(ws):
    return importance_summary(
        permutation_importance(regressor(ws), test_rows(ws), INPUTS, "temperature", "library_id")
    )


@query("d3_partial_dependence")
def _(ws):
    return partial_dependence(regressor(ws), test_rows(ws), INPUTS)


@query("d3_row_profiles")
def _(ws):
    return row_profiles(regressor(ws), test_rows(ws), few(ws, 20), INPUTS, "library_id")


@query("d4_accumulated_dependence")
def _(ws):
    return accumulated_dependence(regressor(ws), test_rows(ws), INPUTS)


@query("d5_break_down")
def _(ws):
    return break_down(regressor(ws), test_rows(ws), few(ws, 2), INPUTS, "library_id")


@query("d5_shapley")
def _(ws):
    return shapley(regressor(ws), test_rows(ws), few(ws, 2), INPUTS, "library_id", samples=5)


@query("d6_residuals")
def _(ws):
    scored = explained(regressor(ws), test_rows(ws), "temperature", "library_id", INPUTS)
    return residuals_by_feature(scored, ["lat", "dop_darwin_clim"])


# --- streaming and the whole job ---------------------------------------------------------------


@query("z1_stream_scoring")
def _(ws):
    arrivals, out, checkpoint = (new_path(ws.spark, n) for n in ("arrivals", "scores", "checkpoint"))
    observations(ws).write.parquet(arrivals)
    stream = arriving(ws.spark, arrivals, observations(ws).schema)
    running = score_stream(regressor(ws), stream.drop("temperature"), "library_id", INPUTS, out, checkpoint)
    running.awaitTermination()
    return ws.spark.read.parquet(out)


@query("k11_train_evaluate")
def _(ws):
    table = rows(ws).where(F.col("temperature").isNotNull()).drop("constant", "rare_flag")
    result = train_regression(
        table, "temperature", "library_id", new_path(ws.spark, "models"), nfolds=2, correlation=0.0,
        candidates={k: v for k, v in small_regressors().items() if k != "GBM_1"}, importance_repeats=2,
    )
    return result.leaderboard


def _class_training(ws):
    def build():
        table = class_table(ws).select("biosample_id", "target", "lat", "depth", "temperature", "section_id", "code")
        return train_classification(
            table, "target", "biosample_id", new_path(ws.spark, "class-models"), correlation=0.0, candidates=small_classifiers()
        )

    return ws.keep("class_training", build)


@query("k11_classification")
def _(ws):
    return _class_training(ws).leaderboard


@query("k11_class_gains")
def _(ws):
    return _class_training(ws).gains
