"""Column profiles and the tables behind charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..operators.chartdata import (
    box_statistics, category_histogram, category_totals, density, histograms, proportion_bars,
)
from ..operators.filters import above
from ..operators.profile import (
    columns_to_impute, columns_to_remove, column_summary, correlated_features, correlation_labels, correlation_matrix,
    correlation_order, correlations, missing_profile, skewed_columns, skewness_profile,
)
from ..operators.rank import share_within
from ..plans.report import data_report
from ..plans.views import map_points
from ..session import new_path
from .registry import query, rounded
from .relational import skewness_sql

METADATA_COLUMNS = (
    "library_id", "latitude_decimal_deg_n", "longitude_decimal_deg_w", "iso_datetime_utc", "depth_m", "section_id",
    "temperature_deg_c", "phosphate_bottle_umol_l", "nitrate_nitrite_bottle_umol_l", "ctd_station_no",
    "sample_method", "platform_strategy", "sra_accession_number",
)


def missing_sql(columns, table="experiment_metadata") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT(*) FILTER ({c} IS NULL) AS num_missing, "
        f"CAST(COUNT(*) FILTER ({c} IS NULL) AS DOUBLE) / COUNT(*) AS pct_missing FROM {table}"
        for c in columns
    )


@query("q1_missing_profile", missing_sql(METADATA_COLUMNS))
def _(ws):
    return missing_profile(ws["experiment_metadata"])


@query("q2_columns_to_remove", "SELECT * EXCLUDE (phosphate_bottle_umol_l) FROM experiment_metadata")
def _(ws):
    return ws["experiment_metadata"].drop(*columns_to_remove(ws["experiment_metadata"]))


@query(
    "q3_columns_to_impute",
    f"SELECT feature, num_missing FROM ({missing_sql(METADATA_COLUMNS)}) x WHERE pct_missing > 0 AND pct_missing <= 0.2",
)
def _(ws):
    df = ws["experiment_metadata"]
    wanted = columns_to_impute(df, columns_to_remove(df))
    return missing_profile(df, wanted).select("feature", "num_missing")


SKEW_COLUMNS = ("fraction_total_reads", "depth_m", "temperature_deg_c", "ctd_station_no", "latitude_decimal_deg_n")


@query(
    "q4_skewed_columns",
    "SELECT feature, value FROM ("
    + " UNION ALL ".join(skewness_sql(c, "species_bracken_summary") for c in ("fraction_total_reads",))
    + ") x WHERE value > 0.8",
)
def _(ws):
    df = ws["species_bracken_summary"]
    wanted = skewed_columns(df, exclude=["name"])
    return skewness_profile(df, wanted).withColumn("value", round_half_up("value", 4))


def correlation_sql(features: dict[str, str], target: str, table: str, digits: int = 6) -> str:
    """Pairwise-complete correlation of named expressions with a target, in SQL."""
    parts = []
    for name, expression in features.items():
        x, y = (f"CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {c} END" for c in ("x", "y"))
        value = f"(SELECT COVAR_POP(x, y) / NULLIF(STDDEV_POP({x}) * STDDEV_POP({y}), 0) FROM (SELECT CAST({expression} AS DOUBLE) AS x, CAST({target} AS DOUBLE) AS y FROM {table}) q)"
        parts.append(f"SELECT '{name}' AS feature, {rounded(value, digits)} AS correlation")
    return " UNION ALL ".join(parts)


NUMERIC_FEATURES = (
    "latitude_decimal_deg_n", "longitude_decimal_deg_w", "depth_m", "phosphate_bottle_umol_l",
    "nitrate_nitrite_bottle_umol_l", "ctd_station_no",
)
TEXT_FEATURES = ("section_id", "sample_method", "platform_strategy")
CORRELATION_SQL = correlation_sql(
    {**{c: c for c in NUMERIC_FEATURES}, **{c: f"{c}_code" for c in TEXT_FEATURES}},
    "temperature_deg_c",
    "(SELECT *, " + ", ".join(f"DENSE_RANK() OVER (ORDER BY {c}) AS {c}_code" for c in TEXT_FEATURES) + " FROM experiment_metadata) t",
)


def _features(ws):
    return ws["experiment_metadata"].select(*NUMERIC_FEATURES, *TEXT_FEATURES, "temperature_deg_c")


@query("q5_target_correlations", CORRELATION_SQL)
def _(ws):
    return correlations(_features(ws), "temperature_deg_c").withColumn("correlation", round_half_up("correlation", 6))


@query(
    "q6_correlation_labels",
    f"SELECT feature, correlation, {rounded('correlation', 2)} AS rounded, REGEXP_REPLACE(CAST(CAST({rounded('correlation', 2)} AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') AS label, "
    f"CASE WHEN correlation >= 0 THEN 'Positive' ELSE 'Negative' END AS sign, ROW_NUMBER() OVER (ORDER BY correlation, feature) AS position FROM ({CORRELATION_SQL}) x",
)
def _(ws):
    table = correlations(_features(ws), "temperature_deg_c", remove_ties=True)
    table = table.withColumn("correlation", round_half_up("correlation", 6))
    return correlation_order(correlation_labels(table))


@query(
    "q7_correlated_columns",
    "SELECT library_id, "
    + "temperature_deg_c, ratio FROM (SELECT *, temperature_deg_c * 2 + ctd_station_no AS ratio FROM experiment_metadata) t",
)
def _(ws):
    df = ws["experiment_metadata"].withColumn("ratio", F.col("temperature_deg_c") * 2 + F.col("ctd_station_no"))
    chosen = correlated_features(df.select("ratio", "temperature_deg_c", "latitude_decimal_deg_n"), "temperature_deg_c", 0.3)
    return df.select("library_id", "temperature_deg_c", *chosen)


MATRIX = ("depth_m", "temperature_deg_c", "phosphate_bottle_umol_l", "nitrate_nitrite_bottle_umol_l")


def _pair_sql(group: str) -> str:
    parts = []
    for i, a in enumerate(MATRIX):
        for b in MATRIX[i + 1 :]:
            both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
            value = f"COVAR_POP({a}, {b}) / NULLIF(STDDEV_POP({a}) {both} * STDDEV_POP({b}) {both}, 0)"
            parts.append(
                f"SELECT {group}, '{a}' AS x, '{b}' AS y, {rounded(value, 6)} AS correlation FROM experiment_metadata GROUP BY {group}"
            )
    return " UNION ALL ".join(parts)


@query("q8_correlation_matrix", _pair_sql("section_id"))
def _(ws):
    table = correlation_matrix(ws["experiment_metadata"], MATRIX, "section_id")
    return table.withColumn("correlation", round_half_up("correlation", 6))


def _summary_sql(numeric=MATRIX, text=("section_id",)) -> str:
    parts = []
    for c in numeric:
        numbers = ", ".join(
            f"{rounded(e, 6)} AS {n}"
            for e, n in (
                (f"AVG({c})", "mean"), (f"STDDEV_SAMP({c})", "sd"), (f"MIN({c})", "p0"),
                (f"QUANTILE_CONT({c}, 0.25)", "p25"), (f"QUANTILE_CONT({c}, 0.5)", "p50"),
                (f"QUANTILE_CONT({c}, 0.75)", "p75"), (f"MAX({c})", "p100"),
            )
        )
        parts.append(
            f"SELECT '{c}' AS feature, 'numeric' AS type, COUNT(*) FILTER ({c} IS NULL) AS num_missing, "
            f"CAST(COUNT(*) FILTER ({c} IS NULL) AS DOUBLE) / COUNT(*) AS pct_missing, COUNT(DISTINCT {c}) AS n_distinct, {numbers} FROM experiment_metadata"
        )
    parts += [
        f"SELECT '{c}', 'character', COUNT(*) FILTER ({c} IS NULL), CAST(COUNT(*) FILTER ({c} IS NULL) AS DOUBLE) / COUNT(*), "
        f"COUNT(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM experiment_metadata"
        for c in text
    ]
    return " UNION ALL ".join(parts)


@query("q9_column_summary", _summary_sql())
def _(ws):
    table = column_summary(ws["experiment_metadata"].select(*MATRIX, "section_id"))
    return table.withColumns({c: round_half_up(c, 6) for c in ("mean", "sd", "p0", "p25", "p50", "p75", "p100")})


@query("q10_data_report")
def _(ws):
    tables = data_report(_features(ws), "temperature_deg_c", new_path(ws.spark, "report"))
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows") for name, df in tables.items()]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def _report(ws, target: str):
    return ws.keep(f"report-{target}", lambda: data_report(_features(ws), target, new_path(ws.spark, "report")))


REPORTED = (*NUMERIC_FEATURES, "temperature_deg_c")


@query("q10_missing", missing_sql((*REPORTED, *TEXT_FEATURES)))
def _(ws):
    return _report(ws, "temperature_deg_c")["missing"]


@query("q10_summary", _summary_sql(REPORTED, TEXT_FEATURES))
def _(ws):
    table = _report(ws, "temperature_deg_c")["summary"]
    return table.withColumns({c: round_half_up(c, 6) for c in ("mean", "sd", "p0", "p25", "p50", "p75", "p100")})


@query("q10_correlations", CORRELATION_SQL)
def _(ws):
    return _report(ws, "temperature_deg_c")["correlations"].withColumn("correlation", round_half_up("correlation", 6))


def report_boxes_sql(group: str | None) -> str:
    """Hinges, whiskers and outliers of every reported number, by a group if one is given."""
    name, keys = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    parts = []
    for c in REPORTED:
        hinges = ", ".join(f"QUANTILE_CONT(x, {q}) OVER ({keys}) AS {n}" for n, q in (("lower", 0.25), ("median", 0.5), ("upper", 0.75)))
        inside = "x BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower)"
        parts.append(
            f"SELECT '{c}' AS feature, {name}COUNT(*) AS n, {rounded('ANY_VALUE(lower)', 6)} AS lower, {rounded('ANY_VALUE(median)', 6)} AS median, "
            f"{rounded('ANY_VALUE(upper)', 6)} AS upper, {rounded(f'MIN(x) FILTER ({inside})', 6)} AS whisker_low, {rounded(f'MAX(x) FILTER ({inside})', 6)} AS whisker_high, "
            f"COUNT(*) FILTER (NOT ({inside})) AS outliers FROM (SELECT *, {hinges} FROM (SELECT {name}CAST({c} AS DOUBLE) AS x FROM experiment_metadata WHERE {c} IS NOT NULL) a) b"
            + (f" GROUP BY {group}" if group else "")
        )
    return " UNION ALL ".join(parts)


def _rounded_boxes(table):
    return table.withColumns({c: round_half_up(c, 6) for c in ("lower", "median", "upper", "whisker_low", "whisker_high")})


@query("q10_boxes", report_boxes_sql(None))
def _(ws):
    return _rounded_boxes(_report(ws, "temperature_deg_c")["boxes"])


@query("q10_class_boxes", report_boxes_sql("section_id"))
def _(ws):
    """The same report for a target of classes: box statistics by class."""
    return _rounded_boxes(_report(ws, "section_id")["boxes"])


@query("q10_components")
def _(ws):
    return _report(ws, "temperature_deg_c")["components"]


# --- chart data --------------------------------------------------------------------------------


def histogram_sql(column: str, table: str, bins: int, expression: str | None = None) -> str:
    value = expression or column
    return (
        f"SELECT '{column}' AS feature, CAST(LEAST(FLOOR((x - lo) / (hi - lo) * {bins}.0::DOUBLE), {bins - 1}) AS INTEGER) AS bin, COUNT(*) AS n FROM "
        f"(SELECT CAST({value} AS DOUBLE) AS x, MIN(CAST({value} AS DOUBLE)) OVER () AS lo, MAX(CAST({value} AS DOUBLE)) OVER () AS hi "
        f"FROM {table} WHERE {column} IS NOT NULL) q GROUP BY 1, 2"
    )


@query(
    "v1_histograms",
    " UNION ALL ".join(
        [histogram_sql(c, "experiment_metadata", 10) for c in ("depth_m", "temperature_deg_c", "phosphate_bottle_umol_l")]
        + [histogram_sql(c, f"(SELECT *, DENSE_RANK() OVER (ORDER BY {c}) AS code FROM experiment_metadata) t", 10, "code") for c in ("section_id", "platform_strategy")]
    ),
)
def _(ws):
    columns = ["depth_m", "temperature_deg_c", "phosphate_bottle_umol_l", "section_id", "platform_strategy"]
    return histograms(ws["experiment_metadata"].select(*columns))


@query("v1_event_histogram", histogram_sql("value", "events", 10))
def _(ws):
    return histograms(ws["events"].select("value"))


@query(
    "v2_category_histogram",
    "SELECT top1_family_name, CAST(LEAST(FLOOR((x - lo) / (hi - lo) * 30.0::DOUBLE), 29) AS INTEGER) AS bin, COUNT(*) AS n FROM "
    "(SELECT top1_family_name, temperature AS x, MIN(temperature) OVER () AS lo, MAX(temperature) OVER () AS hi FROM sample_taxa "
    "WHERE temperature IS NOT NULL) q GROUP BY 1, 2",
)
def _(ws):
    return category_histogram(ws.samples, "temperature", "top1_family_name")


@query(
    "v3_proportion_bars",
    f"SELECT name, value, top1_family_name, n, {rounded('share', 8)} AS share FROM (SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY name, value) AS share FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, top1_family_name, COUNT(*) AS n FROM sample_taxa GROUP BY 2, 3"
        for c in ("section_id", "depth", "code")
    )
    + ") a) b",
)
def _(ws):
    bars = proportion_bars(ws.samples, "top1_family_name", ["section_id", "depth", "code"])
    return bars.withColumn("share", round_half_up("share", 8))


def density_sql(table: str, facet: str, grp: str, value: str, points: int) -> str:
    last = points - 1
    return f"""
WITH kd_rows AS (SELECT {facet} AS f, {grp} AS g, CAST({value} AS DOUBLE) AS x FROM {table}
                 WHERE {value} IS NOT NULL AND {facet} IS NOT NULL AND {grp} IS NOT NULL),
kd_spread AS (SELECT f, g, COUNT(*) AS n, STDDEV_SAMP(x) AS sd, QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.75) AS q3,
                     MAX(ABS(x)) AS far, MIN(x) AS lo, MAX(x) AS hi FROM kd_rows GROUP BY f, g HAVING COUNT(*) > 1),
kd_facet AS (SELECT f, MIN(lo) AS lo, MAX(hi) AS hi FROM kd_spread GROUP BY f),
kd_set AS (SELECT s.f, s.g, s.n, 0.9 * (CASE WHEN LEAST(sd, (q3 - q1) / 1.34) > 0 THEN LEAST(sd, (q3 - q1) / 1.34)
              WHEN sd > 0 THEN sd WHEN far > 0 THEN far ELSE 1 END) * POWER(s.n, -0.2) AS bw, k.lo, k.hi,
              (k.hi - k.lo) / {last} AS step FROM kd_spread s JOIN kd_facet k ON s.f = k.f),
kd_place AS (SELECT r.f, r.g, COALESCE((r.x - k.lo) * {last} / NULLIF(k.hi - k.lo, 0), 0) AS p FROM kd_rows r JOIN kd_facet k ON r.f = k.f),
kd_low AS (SELECT f, g, p, LEAST(FLOOR(p), {last - 1}) AS c FROM kd_place),
kd_cells AS (SELECT f, g, c, SUM(w) AS w FROM (SELECT f, g, c, 1 - (p - c) AS w FROM kd_low UNION ALL SELECT f, g, c + 1, p - c FROM kd_low) u GROUP BY f, g, c),
kd_points AS (SELECT UNNEST(RANGE(0, {points})) AS i)
SELECT s.f AS {facet}, s.g AS {grp}, CAST(i AS INTEGER) AS point, {rounded('ANY_VALUE(s.lo + i * s.step)', 6)} AS x,
       {rounded('SUM(w * EXP(-POWER((i - c) * s.step / s.bw, 2) / 2)) / (ANY_VALUE(s.n) * ANY_VALUE(s.bw) * SQRT(2 * PI()))', 5)} AS density
FROM kd_set s JOIN kd_cells k ON s.f = k.f AND s.g = k.g CROSS JOIN kd_points GROUP BY s.f, s.g, i"""


@query("v4_density", density_sql("experiment_metadata", "section_id", "sample_method", "temperature_deg_c", 512))
def _(ws):
    table = density(ws["experiment_metadata"], "section_id", "sample_method", "temperature_deg_c", points=512)
    return table.withColumns({"x": round_half_up("x", 6), "density": round_half_up("density", 5)})


def box_sql(table: str, group: str, value: str) -> str:
    return f"""
WITH bx_rows AS (SELECT {group} AS g, CAST({value} AS DOUBLE) AS x FROM {table} WHERE {value} IS NOT NULL),
bx_hinges AS (SELECT g, COUNT(*) AS n, QUANTILE_CONT(x, 0.25) AS a, QUANTILE_CONT(x, 0.5) AS b, QUANTILE_CONT(x, 0.75) AS c FROM bx_rows GROUP BY g),
bx_fences AS (SELECT *, a - 1.5 * (c - a) AS lo, c + 1.5 * (c - a) AS hi FROM bx_hinges)
SELECT h.g AS {group}, h.n, {rounded('h.a', 6)} AS lower, {rounded('h.b', 6)} AS median, {rounded('h.c', 6)} AS upper,
       {rounded('MIN(x) FILTER (x BETWEEN lo AND hi)', 6)} AS whisker_low, {rounded('MAX(x) FILTER (x BETWEEN lo AND hi)', 6)} AS whisker_high,
       COUNT(*) FILTER (NOT x BETWEEN lo AND hi) AS outliers
FROM bx_rows r JOIN bx_fences h ON r.g IS NOT DISTINCT FROM h.g GROUP BY h.g, h.n, h.a, h.b, h.c"""


def rounded_box(table):
    return table.withColumns(
        {c: round_half_up(c, 6) for c in ("lower", "median", "upper", "whisker_low", "whisker_high")}
    )


@query("v5_box_statistics", box_sql("family_bracken_summary", "name", "fraction_total_reads"))
def _(ws):
    return rounded_box(box_statistics(ws["family_bracken_summary"], ["name"], "fraction_total_reads"))


@query("v5_event_boxes", box_sql("events", "event_type", "value"))
def _(ws):
    return rounded_box(box_statistics(ws["events"], ["event_type"], "value"))


@query("v6_category_totals", "SELECT taxon_name, COUNT(*) AS n FROM sample_taxa GROUP BY taxon_name")
def _(ws):
    return category_totals(ws.samples, "taxon_name")


@query("v7_map_rows", "SELECT DISTINCT biosample_id, top1_family_name, family_number, species_number, lat, lon, taxon_name FROM "
       "(SELECT *, RANK() OVER (PARTITION BY biosample_id ORDER BY fraction_total_reads DESC NULLS LAST) AS r FROM working) x "
       "WHERE r = 1 AND fraction_total_reads IS NOT NULL")
def _(ws):
    points = map_points(ws.working, 5)
    return points.select("biosample_id", "top1_family_name", "family_number", "species_number", "lat", "lon", "taxon_name").distinct()


@query(
    "v8_share_by_depth",
    f"SELECT depth, taxon_name, n, {rounded('CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY depth) * 100', 8)} AS percent FROM "
    "(SELECT depth, taxon_name, COUNT(*) AS n FROM working WHERE fraction_total_reads > 0.15 GROUP BY depth, taxon_name) x",
)
def _(ws):
    shares = share_within(above(ws.working, "fraction_total_reads", 0.15), ["depth"], "taxon_name")
    return shares.withColumn("percent", round_half_up("percent", 8))
