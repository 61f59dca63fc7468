"""Scoring and explanation of a model with fixed coefficients, so that SQL can say what must come out.

Explanation and scoring take any transformer; the trained models of ``modelling`` have the same
operators run on them, but their figures differ between engines.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..operators.explain import (
    accumulated_dependence, break_down, explained, partial_dependence, permutation_importance, row_profiles, shapley,
)
from ..operators.metrics import class_metrics
from ..operators.models import PREDICTED, AddMissing, score, score_long
from ..operators.resample import hash_sample
from ..session import new_path
from ..streaming.scoring import arriving, score_stream
from .registry import query, rounded

FEATURES = ["a", "b", "c"]
ORDERS_SQL = """(SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_totalprice / 1000 AS a, CAST(o_custkey % 100 AS DOUBLE) / 10 AS b,
    CAST(o_orderkey % 7 AS DOUBLE) AS c, o_totalprice / 500 AS y FROM orders)"""
PREDICT = "2.0 * {a} + 30.0 * {b} - 10.0 * {c} + {a} * {b}"
#: The orders that are explained one by one.
EXPLAINED = ("1", "2")


def predict_sql(a: str = "a", b: str = "b", c: str = "c") -> str:
    """The prediction in SQL; every number is a double on both sides."""
    return "CAST(" + PREDICT.format(a=a, b=b, c=c).replace(".0 ", ".0::DOUBLE ") + " AS DOUBLE)"


def orders(ws):
    return ws["orders"].select(
        F.col("o_orderkey").cast("string").alias("order_id"), (F.col("o_totalprice") / 1000).alias("a"),
        ((F.col("o_custkey") % 100).cast("double") / 10).alias("b"), (F.col("o_orderkey") % 7).cast("double").alias("c"),
        (F.col("o_totalprice") / 500).alias("y"),
    )


def fixed_model(statement: str = PREDICT.format(a="a", b="b", c="c")) -> PipelineModel:
    inputs = AddMissing(columns=FEATURES)
    return PipelineModel(stages=[inputs, SQLTransformer(statement=f"SELECT *, CAST({statement} AS DOUBLE) AS {PREDICTED} FROM __THIS__")])


def observed(ws):
    return orders(ws).where(F.col("order_id").isin(*EXPLAINED))


OBSERVED_SQL = f"(SELECT * FROM {ORDERS_SQL} l WHERE order_id IN {EXPLAINED})"


@query(
    "d1_fixed_explainer",
    f"SELECT order_id, a, b, c, y AS truth, {rounded(predict_sql(), 6)} AS prediction, {rounded(f'y - {predict_sql()}', 6)} AS residual FROM {ORDERS_SQL} l",
)
def _(ws):
    found = explained(fixed_model(), orders(ws), "y", "order_id", FEATURES)
    return found.withColumns({c: round_half_up(c, 6) for c in ("prediction", "residual")})


def _grid_sql(points: int = 11) -> str:
    """feature and x: the distinct quantiles at even shares."""
    parts = [
        f"SELECT '{f}' AS feature, UNNEST([{', '.join(f'QUANTILE_CONT({f}, {i / (points - 1)!r})' for i in range(points))}]) AS x FROM {ORDERS_SQL} l"
        for f in FEATURES
    ]
    return f"(SELECT DISTINCT feature, x FROM ({' UNION ALL '.join(parts)}) g)"


def _moved_sql(rows: str, keep: str = "") -> str:
    """Every row once for each grid point, with the point's feature set to it."""
    cells = ", ".join(f"CASE WHEN feature = '{f}' THEN x ELSE {f} END AS {f}" for f in FEATURES)
    return f"(SELECT {keep} feature, x, {cells} FROM {rows} r, {_grid_sql()} g)"


@query(
    "d3_fixed_partial_dependence",
    f"SELECT feature, {rounded('x', 8)} AS x, {rounded(f'AVG({predict_sql()})', 6)} AS mean FROM {_moved_sql(ORDERS_SQL)} m GROUP BY feature, m.x",
)
def _(ws):
    found = partial_dependence(fixed_model(), orders(ws), FEATURES)
    return found.withColumns({"x": round_half_up("x", 8), "mean": round_half_up("mean", 6)})


@query(
    "d3_fixed_row_profiles",
    f"SELECT order_id, feature, {rounded('x', 8)} AS x, {rounded(predict_sql(), 6)} AS prediction FROM {_moved_sql(OBSERVED_SQL, 'order_id,')} m",
)
def _(ws):
    found = row_profiles(fixed_model(), orders(ws), observed(ws), FEATURES, "order_id")
    return found.withColumns({"x": round_half_up("x", 8), "prediction": round_half_up("prediction", 6)})


#: Without the product, so that a step's effect is the coefficient times its width.
ADDITIVE = "2.0 * a + 30.0 * b - 10.0 * c"
COEFFICIENTS = {"a": 2.0, "b": 30.0, "c": -10.0}


def _accumulated_sql() -> str:
    steps = f"(SELECT *, LEAD(x) OVER (PARTITION BY feature ORDER BY x) AS next, MIN(x) OVER (PARTITION BY feature) AS low, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY x) AS i FROM {_grid_sql()} g)"
    parts = []
    for f, k in COEFFICIENTS.items():
        centre = (
            f"(SELECT AVG({k}::DOUBLE * ((s.x + s.next) / 2 - s.low)) FROM {ORDERS_SQL} l JOIN {steps} s ON s.feature = '{f}' AND s.next IS NOT NULL "
            f"AND (l.{f} > s.x OR s.i = 1) AND l.{f} <= s.next)"
        )
        parts.append(f"SELECT '{f}' AS feature, {rounded('x', 8)} AS x, {rounded(f'{k}::DOUBLE * (x - low) - {centre}', 6)} AS effect FROM {steps} t WHERE feature = '{f}'")
    return " UNION ALL ".join(parts)


@query("d4_fixed_accumulated_dependence", _accumulated_sql())
def _(ws):
    found = accumulated_dependence(fixed_model(ADDITIVE), orders(ws), FEATURES)
    return found.withColumns({"x": round_half_up("x", 8), "effect": round_half_up("effect", 6)})


def _break_down_sql() -> str:
    before, fixed = f"AVG({predict_sql('l.a', 'l.b', 'l.c')})", {}
    one = f"FROM {ORDERS_SQL} l, {OBSERVED_SQL} o GROUP BY o.order_id"
    parts = [f"SELECT o.order_id, '(mean)' AS feature, {rounded(before, 6)} AS contribution {one}"]
    for f in FEATURES:
        fixed[f] = f"o.{f}"
        after = f"AVG({predict_sql(*[fixed.get(g, f'l.{g}') for g in FEATURES])})"
        parts.append(f"SELECT o.order_id, '{f}' AS feature, {rounded(f'{after} - {before}', 6)} AS contribution {one}")
        before = after
    return " UNION ALL ".join(parts)


def _importance_sql() -> str:
    place = "ROW_NUMBER() OVER (ORDER BY ((o_orderkey % 1000003) * (2654435761 % 1000003) + 1) % 1000003, o_orderkey)"
    rows = f"SELECT l.*, o_orderkey, {place} AS place, COUNT(*) OVER () AS n FROM {ORDERS_SQL} l JOIN orders ON order_id = CAST(o_orderkey AS VARCHAR)"
    loss = lambda guess: f"SQRT(AVG(POWER(l.y - {guess}, 2)))"
    parts = []
    for f in FEATURES:
        moved = loss(predict_sql(*[f"{'d' if g == f else 'l'}.{g}" for g in FEATURES]))
        parts.append(
            f"SELECT '{f}' AS feature, CAST(repeat AS INTEGER) AS repeat, {rounded(moved, 5)} AS loss, {rounded(f'{moved} - ANY_VALUE(base)', 5)} AS rise "
            "FROM pi_rows l JOIN pi_repeats ON TRUE JOIN pi_base ON TRUE JOIN pi_rows d ON d.place = (l.place + repeat * 2654435761 % (l.n - 1)) % l.n + 1 GROUP BY repeat"
        )
    base = loss(predict_sql("l.a", "l.b", "l.c"))
    return (
        f"WITH pi_rows AS ({rows}), pi_repeats AS (SELECT UNNEST(RANGE(1, 11)) AS repeat), pi_base AS (SELECT {base} AS base FROM pi_rows l) "
        + " UNION ALL ".join(parts)
    )


@query("d2_fixed_importance", _importance_sql())
def _(ws):
    rows = ws["orders"].select("o_orderkey", F.col("o_orderkey").cast("string").alias("order_id")).join(orders(ws), "order_id")
    found = permutation_importance(fixed_model(), rows, FEATURES, "y", "o_orderkey", method="arithmetic")
    return found.withColumns({c: round_half_up(c, 5) for c in ("loss", "rise")})


@query("d5_fixed_break_down", _break_down_sql())
def _(ws):
    found = break_down(fixed_model(), orders(ws), observed(ws), FEATURES, "order_id")
    return found.withColumn("contribution", round_half_up("contribution", 6))


@query(
    "d5_fixed_shapley",
    " UNION ALL ".join(
        f"SELECT o.order_id, '{f}' AS feature, {rounded(f'ANY_VALUE({k}::DOUBLE * o.{f}) - AVG({k}::DOUBLE * l.{f})', 6)} AS contribution, 0.0::DOUBLE AS spread "
        f"FROM {ORDERS_SQL} l, {OBSERVED_SQL} o GROUP BY o.order_id"
        for f, k in COEFFICIENTS.items()
    ),
)
def _(ws):
    found = shapley(fixed_model(ADDITIVE), orders(ws), observed(ws), FEATURES, "order_id", samples=4)
    found = found.where("feature <> '(mean)'")
    return found.withColumns({c: round_half_up(c, 6) for c in ("contribution", "spread")})


@query("l9_fixed_scoring", f"SELECT *, {rounded(predict_sql(), 6)} AS predict FROM {ORDERS_SQL} l")
def _(ws):
    return score(fixed_model(), orders(ws)).withColumn(PREDICTED, round_half_up(PREDICTED, 6))


LONG_SQL = " UNION ALL ".join(
    f"SELECT order_id, '{name}' AS name, {value} AS value FROM {ORDERS_SQL} l"
    for name, value in (("y", rounded(predict_sql(), 6)), *((f, rounded(f, 6)) for f in FEATURES))
)


@query("l10_fixed_scoring_rows", LONG_SQL)
def _(ws):
    found = score_long(fixed_model(), orders(ws).drop("y"), "order_id", FEATURES, outcome="y")
    return found.withColumn("value", round_half_up("value", 6))


@query("l11_fixed_missing_inputs", f"SELECT order_id, a, NULL::DOUBLE AS b, NULL::DOUBLE AS c, {rounded('CAST(2.0::DOUBLE * a AS DOUBLE)', 6)} AS predict FROM {ORDERS_SQL} l")
def _(ws):
    model = fixed_model("2.0 * a + coalesce(30.0 * b, 0) - coalesce(10.0 * c, 0)")
    found = score(model, orders(ws).select("order_id", "a"))
    return found.withColumn(PREDICTED, round_half_up(PREDICTED, 6))


@query("z1_fixed_stream_scoring", LONG_SQL)
def _(ws):
    arrivals, out, checkpoint = (new_path(ws.spark, n) for n in ("arrivals", "scores", "checkpoint"))
    table = orders(ws).drop("y")
    table.write.parquet(arrivals)
    stream = arriving(ws.spark, arrivals, table.schema)
    score_stream(fixed_model(), stream, "order_id", FEATURES, out, checkpoint, outcome="y").awaitTermination()
    return ws.spark.read.parquet(out).withColumn("value", round_half_up("value", 6))


@query(
    "t3_hash_sample",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE ((o_orderkey % 1000003) * (2654435761 % 1000003) + 7) % 1000003 < 100000",
)
def _(ws):
    return hash_sample(ws["orders"].select("o_orderkey", "o_totalprice"), "o_orderkey", 0.1, seed=7, method="arithmetic")


TRUTHS_SQL = (
    "(SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS grp, CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus END AS truth, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS guess FROM orders)"
)


@query(
    "e4_missing_truths",
    f"""WITH k AS (SELECT * FROM {TRUTHS_SQL} t WHERE truth IS NOT NULL),
    l AS (SELECT grp, truth AS level, COUNT(*) AS positives, COUNT(*) FILTER (guess = truth) AS tp FROM k GROUP BY grp, truth),
    g AS (SELECT grp, guess AS level, COUNT(*) AS guessed FROM k GROUP BY grp, guess),
    n AS (SELECT grp, COUNT(*) AS whole FROM k GROUP BY grp),
    r AS (SELECT l.grp, AVG(tp / positives) AS sensitivity, AVG((whole - positives - (COALESCE(guessed, 0) - tp)) / NULLIF(whole - positives, 0)) AS specificity
          FROM l LEFT JOIN g ON l.grp IS NOT DISTINCT FROM g.grp AND l.level = g.level JOIN n ON l.grp IS NOT DISTINCT FROM n.grp GROUP BY l.grp)
    SELECT grp, 'accuracy' AS metric, {rounded('CAST(COUNT(*) FILTER (truth = guess) AS DOUBLE) / COUNT(*)', 6)} AS value FROM k GROUP BY grp
    UNION ALL SELECT grp, 'sensitivity', {rounded('sensitivity', 6)} FROM r UNION ALL SELECT grp, 'specificity', {rounded('specificity', 6)} FROM r""",
)
def _(ws):
    some = lambda test, value: F.expr(f"CASE WHEN {test} THEN {value} END")
    df = ws["orders"].select(
        some("o_orderkey % 5 > 0", "o_orderpriority").alias("grp"), some("o_custkey % 4 > 0", "o_orderstatus").alias("truth"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END").alias("guess"),
    )
    return class_metrics(df, "truth", "guess", ["grp"]).withColumn("value", round_half_up("value", 6))
