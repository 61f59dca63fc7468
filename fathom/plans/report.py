"""A data report against a target, as tables instead of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_doubles, long_cells, names_sql, numeric_columns, text_columns
from ..operators.chartdata import box_statistics, histograms
from ..operators.products import leading_values
from ..operators.profile import column_summary, correlation_matrix, correlations, missing_profile
from ..session import materialise


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Share of variance of the leading components of the standardised complete rows.

    From the correlations of all pairs, by blocks of columns; no matrix of all columns comes to the driver.
    """
    complete = as_doubles(df, columns).dropna()
    table = materialise(correlation_matrix(complete, columns), "correlations")
    place = F.array(*[F.lit(c) for c in columns])
    pairs = table.select(*[(F.array_position(place, F.col(v)) - 1).cast("int").alias(n) for v, n in (("x", "i"), ("y", "j"))], "correlation")
    values = leading_values(pairs, len(columns), k)
    shares = [(i + 1, v / len(columns)) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(shares, "component int, share double")


def data_report(df: DataFrame, target: str, path: str, bins: int = 10) -> dict[str, DataFrame]:
    """Write the report tables below ``path`` and return them: missing values, summaries,
    histograms, correlations, box statistics of every numeric column by target, components."""
    numeric = numeric_columns(df)
    tables = {
        "missing": missing_profile(df),
        "summary": column_summary(df),
        "histograms": histograms(df.select(*names_sql([*numeric, *text_columns(df)])), bins),
        "correlations": correlations(df, target),
        "components": principal_components(df, [c for c in numeric if c != target]),
    }
    if target in numeric:
        boxes = long_cells(df, numeric, cast="double")
        tables["boxes"] = box_statistics(boxes, ["feature"], "value")
    else:
        boxes = as_doubles(df, numeric, [target]).unpivot([target], names_sql(numeric), "feature", "value")
        tables["boxes"] = box_statistics(boxes, ["feature", target], "value")
    written = {}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        written[name] = df.sparkSession.read.parquet(f"{path}/{name}")
    return written
