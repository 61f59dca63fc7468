"""Column profiles: missing values, skewness, correlation, summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_doubles, name_sql, names_sql, numeric_columns, quoted, text_columns, text_literal
from ..functions.numbers import correlation_sql, number_text, round_half_up, sign_label, skewness_sql
from .ordering import dense_codes, exact_quantiles, running_totals
from .products import pair_products
from .rank import first_of_ties, numbered


# From this many columns on, aggregates run over (feature, value) cells: one small set of aggregates
# for all columns instead of a generated method per column that is too long to be compiled.
WIDE_LIMIT = 30


def per_column(
    df: DataFrame, columns: Sequence[str], metrics: Mapping[str, Callable[[str], str]], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per column with the given aggregates (as SQL text), from a single pass over the rows.

    ``keep`` names further columns that the aggregates use.
    """
    if len(columns) < WIDE_LIMIT:
        return _aggregated_wide(df, columns, metrics)
    kind = "double" if set(columns) <= set(numeric_columns(df)) else "string"
    names = names_sql(columns)
    others = [c for c in keep if c not in columns]
    narrow = df.selectExpr(*names_sql(others), *[f"CAST({c} AS {kind}) AS {c}" for c in names])
    cells = narrow.unpivot(names_sql(others), names, "feature", "value")
    return cells.groupBy("feature").agg(*[F.expr(measure("value")).alias(name) for name, measure in metrics.items()])


def _aggregated_wide(df: DataFrame, columns: Sequence[str], metrics: Mapping[str, Callable[[str], str]]) -> DataFrame:
    aggregates = [
        f"{measure(name_sql(c))} AS {name}_{i}" for i, c in enumerate(columns) for name, measure in metrics.items()
    ]
    rows = [
        f"struct({text_literal(c)} AS feature, " + ", ".join(f"{name}_{i} AS {name}" for name in metrics) + ")"
        for i, c in enumerate(columns)
    ]
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, num_missing, pct_missing (a fraction), largest first."""
    columns = list(columns) if columns is not None else df.columns
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    is_missing = {
        name_sql(c): f"({name_sql(c)} IS NULL" + (f" OR isnan({name_sql(c)}))" if c in floating else ")") for c in columns
    }
    return _aggregated_wide(
        df,
        columns,
        {
            "num_missing": lambda c: f"count_if({is_missing[c]})",
            "pct_missing": lambda c: f"try_divide(CAST(count_if({is_missing[c]}) AS DOUBLE), count(1))",
        },
    ).orderBy(F.col("pct_missing").desc_nulls_last(), "feature")


def _names(features: DataFrame) -> list[str]:
    """Feature names in row order: at most one row per column of a table."""
    return [r.feature for r in features.select("feature").collect()]


def columns_to_remove(df: DataFrame, threshold: float = 0.2) -> list[str]:
    return _names(missing_profile(df).where(F.col("pct_missing") > threshold))


def columns_to_impute(df: DataFrame, removed: Sequence[str] = ()) -> list[str]:
    rest = [c for c in df.columns if c not in set(removed)]
    return _names(missing_profile(df, rest).where(F.col("pct_missing") > 0))


def skewness_profile(
    df: DataFrame, columns: Sequence[str] | None = None, na_propagate: bool = False
) -> DataFrame:
    """feature, value: population skewness of each numeric column, largest first."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    return per_column(df, columns, {"value": lambda c: skewness_sql(c, na_propagate)}).orderBy(
        F.col("value").desc_nulls_last(), "feature"
    )


def skewed_columns(
    df: DataFrame,
    exclude: Sequence[str] = (),
    threshold: float = 0.8,
    absolute: bool = False,
    na_propagate: bool = True,
) -> list[str]:
    """Numeric columns skewed above the threshold; ``absolute`` takes both tails, threshold included."""
    columns = [c for c in numeric_columns(df) if c not in set(exclude)]
    profile = skewness_profile(df, columns, na_propagate)
    keep = F.abs("value") >= threshold if absolute else F.col("value") > threshold
    return _names(profile.where(keep))


def with_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace text columns by their 1-based alphabetical codes; missing stays missing."""
    order = df.columns
    for c in columns:
        codes = dense_codes(df, [], c, "_code").withColumnRenamed(c, "_value")
        df = df.join(codes, df[c] == codes["_value"], "left").drop("_value", c)
        df = df.withColumnRenamed("_code", c)
    return df.select(*names_sql(order))


def _coded_target(df: DataFrame, target: str) -> DataFrame:
    return with_codes(df, [target]) if target in text_columns(df) else df


def correlations(df: DataFrame, target: str, remove_ties: bool = False) -> DataFrame:
    """feature, correlation: every column against the target, text columns as alphabetical codes.

    Numeric columns take one pass. Text columns are first counted by (feature, value), so that
    codes are only joined to distinct values, never to rows.
    """
    df = _coded_target(df, target)
    numeric = [c for c in numeric_columns(df) if c != target]
    text = [c for c in text_columns(df) if c != target]
    parts = []
    if numeric:
        parts.append(per_column(df, numeric, {"correlation": lambda c: correlation_sql(c, name_sql(target))}, [target]))
    if text:
        parts.append(_text_correlations(df.select(quoted(target).cast("double").alias("_y"), *names_sql(text)), text))
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return first_of_ties(result, "correlation", "feature") if remove_ties else result


def _text_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = df.unpivot(["_y"], names_sql(columns), "feature", "value")
    counts = (
        cells.where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(
            F.count("_y").alias("n"),
            F.sum("_y").alias("sy"),
            F.sum(F.col("_y") * F.col("_y")).alias("syy"),
            F.min("_y").alias("low"),
            F.max("_y").alias("high"),
            F.lit(1).cast("long").alias("_one"),
        )
    )
    coded = running_totals(counts, ["feature"], "value", ["_one"]).withColumn("x", F.col("cum__one").cast("double"))
    seen = F.col("n") > 0
    sums = coded.groupBy("feature").agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n") * F.col("x")).alias("sx"),
        F.sum(F.col("n") * F.col("x") * F.col("x")).alias("sxx"),
        F.sum("sy").alias("sy"),
        F.sum("syy").alias("syy"),
        F.sum(F.col("x") * F.col("sy")).alias("sxy"),
        (F.min(F.when(seen, F.col("x"))) < F.max(F.when(seen, F.col("x")))).alias("x_varies"),
        (F.min("low") < F.max("high")).alias("y_varies"),
    )
    x_part = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    y_part = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    value = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(x_part) * F.sqrt(y_part))
    found = sums.select("feature", F.when(F.col("x_varies") & F.col("y_varies"), value).alias("correlation"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(found, "feature", "left")


def correlation_order(table: DataFrame, descending: bool = False) -> DataFrame:
    """Features numbered by their correlation, ties by name."""
    return numbered(table, ["correlation", "feature"], descending)


def correlation_labels(table: DataFrame, digits: int = 2) -> DataFrame:
    """Add the rounded value, its text and the sign label; a missing value counts as negative."""
    return table.select(
        "feature",
        "correlation",
        round_half_up("correlation", digits).alias("rounded"),
        number_text("correlation", digits).alias("label"),
        sign_label("correlation").alias("sign"),
    )


def correlated_features(
    df: DataFrame, target: str, threshold: float = 0.09, remove_ties: bool = True
) -> list[str]:
    """Features whose absolute correlation with the target exceeds the threshold, largest first."""
    table = correlations(df, target, remove_ties)
    return _names(
        table.where(F.abs("correlation") > threshold).orderBy(F.col("correlation").desc(), "feature")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """Upper triangle of the pairwise correlations as long rows, optionally per group.

    A pair is correlated over the rows that have both values; without any, or if one of them never differs
    there, the correlation is missing. Products are made by blocks of columns (``products.pair_products``).
    """
    columns = list(columns)
    keys = [group] if group else []
    sums = pair_products(df, columns, group)
    n, a, b, aa, bb, ab = (F.col(c) for c in ("n", "a", "b", "aa", "bb", "ab"))
    spread = lambda square, total: square - total * total / n
    flat = lambda square, total: spread(square, total) <= F.lit(1e-13) * square
    value = (ab - a * b / n) / F.sqrt(spread(aa, a) * spread(bb, b))
    kept = F.when((n > 0) & ~flat(aa, a) & ~flat(bb, b), F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)))
    names = F.array(*[F.lit(c) for c in columns])
    name = lambda c: F.get(names, F.col(c))
    return sums.select(*[quoted(k) for k in keys], name("i").alias("x"), name("j").alias("y"), kept.alias("correlation"))


def column_summary(df: DataFrame) -> DataFrame:
    """One row per numeric or text column: type, missing, distinct, mean, sd, quartiles, range."""
    numeric, text = numeric_columns(df), text_columns(df)
    missing = missing_profile(df, [*numeric, *text])
    parts = []
    if numeric:
        moments = per_column(
            df,
            numeric,
            {"mean": lambda c: f"avg(CAST({c} AS DOUBLE))", "sd": lambda c: f"stddev_samp(CAST({c} AS DOUBLE))"},
        )
        cells = as_doubles(df, numeric).unpivot([], names_sql(numeric), "feature", "value")
        spread = exact_quantiles(cells, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
        parts.append(
            moments.join(spread, "feature", "left").select(
                "feature", F.lit("numeric").alias("type"),
                F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
                "mean", "sd", F.col("low").alias("p0"), "p25", "p50", "p75", F.col("high").alias("p100"),
            )
        )
    if text:
        counts = per_column(df, text, {"n_distinct": lambda c: f"count(DISTINCT {c})"})
        parts.append(counts.select("feature", F.lit("character").alias("type"), "n_distinct"))
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return missing.join(result, "feature").select(
        "feature", "type", "num_missing", "pct_missing", *[c for c in result.columns if c not in ("feature", "type")]
    )
