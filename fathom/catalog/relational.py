"""Sources, projections, filters, joins, aggregates, windows, sorts and reshaping."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    column_range, columns_except, map_columns, numeric_columns, pull, select_unique, text_columns,
)
from ..functions.numbers import (
    clamp_negative, count_distinct_na, exact_avg, na_propagating, number_text, percent_text, round_half_up, sign_label,
)
from ..functions.text import (
    date_part, date_text, first_match, first_token, or_na_text, parse_date, subject_matches, truncate_text,
    with_clean_names,
)
from ..operators.chartdata import group_percentage, hexagon_means
from ..operators.filters import FilterSpec, above, apply_filters, default_bounds, keep_members, without_taxon
from ..operators.joins import left_join, left_join_many, membership_table, natural_left_join
from ..operators.ordering import dense_codes, running_totals
from ..operators.profile import missing_profile, skewness_profile, with_codes
from ..operators.rank import (
    appearance_order, category_order, first_of_ties, group_maximum, numbered, share_within, top_n_with_ties,
)
from ..operators.reshape import bind_rows, lengthen, nest, one_wide_row, rename, unnest, widen
from ..plans.collate import leading_taxa, taxon_counts
from ..plans.views import CRUISES, column_to_string, key_figures, link_rules
from ..session import materialise, new_path
from ..sources.schemas import CLIMATOLOGY, PROVINCE
from ..sources.tables import load_catalogue, read_csv, read_table, rows_from_scalars, write_csv, write_store
from .registry import exact_avg_sql, exact_sum_sql, number_sql, percent_sql, query, rounded
from .standins import BASE_TABLES, CONTAMINANT_FAMILY, CONTAMINANT_SPECIES
from .workspace import Workspace

# --- sources and sinks -------------------------------------------------------------------------


@query("s1_scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(ws: Workspace) -> DataFrame:
    orders = read_table(ws.spark, f"{ws.folder}/orders.parquet")
    return orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")


@query("s2_scan_store", "SELECT biosample_id, taxon_name, fraction_total_reads FROM sample_taxa WHERE section_id = 'P18'")
def _(ws):
    return ws.samples.filter(F.col("section_id") == "P18").select("biosample_id", "taxon_name", "fraction_total_reads")


@query("s3_load_declared", "SELECT library_id, lat, lon, code, description FROM longhurst")
def _(ws):
    path = new_path(ws.spark, "province")
    write_store(ws["longhurst"], path)
    return read_table(ws.spark, path, schema=PROVINCE)


@query(
    "s4_catalogue",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in BASE_TABLES),
)
def _(ws):
    for t in BASE_TABLES:
        ws[t].createOrReplaceTempView(t)
    tables = {n: df for n, df in load_catalogue(ws.spark).items() if n in BASE_TABLES}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in tables.items()]
    return bind_rows(*counts)


@query("s5_overwrite_table", "SELECT library_id, col_date, depth FROM sample_taxa WHERE taxon_name = 'Brand#2'")
def _(ws):
    path = new_path(ws.spark, "overwritten")
    rows = ws.samples.select("library_id", "col_date", "depth", "taxon_name")
    write_store(rows, path)
    write_store(rows.filter(F.col("taxon_name") == "Brand#2").drop("taxon_name"), path)
    return read_table(ws.spark, path)


@query("s6_csv", "SELECT library_id, variable, value FROM climatology")
def _(ws):
    path = new_path(ws.spark, "csv")
    write_csv(ws["climatology"], path)
    return read_csv(ws.spark, path, CLIMATOLOGY)


@query(
    "s7_rows_from_scalars",
    "SELECT v.cruise AS cruise, v.page AS page, COUNT(m.library_id) AS n FROM (VALUES "
    + ", ".join(f"('{name}', '{page}')" for _, name, page in CRUISES)
    + ") AS v(cruise, page) LEFT JOIN experiment_metadata m ON v.cruise = m.section_id GROUP BY v.cruise, v.page",
)
def _(ws):
    schema = T.StructType().add("cruise", "string").add("page", "string")
    cruises = rows_from_scalars(ws.spark, [(name, page) for _, name, page in CRUISES], schema)
    counts = ws["experiment_metadata"].groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    return left_join(cruises, counts, {"cruise": "section_id"}).withColumn("n", F.coalesce("n", F.lit(0)))


@query("s8_materialise", "SELECT name, COUNT(*) AS n FROM species_bracken_summary GROUP BY name")
def _(ws):
    return materialise(ws["species_bracken_summary"].groupBy("name").agg(F.count(F.lit(1)).alias("n")), "counts")


# --- projections -------------------------------------------------------------------------------


@query("p1_select", "SELECT library_id, section_id, depth_m FROM experiment_metadata")
def _(ws):
    return ws["experiment_metadata"].select("library_id", "section_id", "depth_m")


@query(
    "p2_select_rename",
    "SELECT library_id, latitude_decimal_deg_n AS lat, longitude_decimal_deg_w AS lon, depth_m AS depth "
    "FROM experiment_metadata",
)
def _(ws):
    return ws["experiment_metadata"].select(
        "library_id",
        F.col("latitude_decimal_deg_n").alias("lat"),
        F.col("longitude_decimal_deg_w").alias("lon"),
        F.col("depth_m").alias("depth"),
    )


@query("p3_drop", "SELECT * EXCLUDE (read_count, fastq_bytes, lat_longhurst, lon_longhurst, sample_id) FROM sample_taxa")
def _(ws):
    return ws.samples.drop("read_count", "fastq_bytes", "lat_longhurst", "lon_longhurst", "sample_id")


@query(
    "p4_rename",
    "SELECT library_id, lat AS lat_longhurst, lon AS lon_longhurst, code, description AS longhurst_description FROM longhurst",
)
def _(ws):
    return rename(
        ws["longhurst"],
        {"lat": "lat_longhurst", "lon": "lon_longhurst", "description": "longhurst_description"},
    )


@query(
    "p5_add_columns",
    "SELECT library_id, FeT_darwin_clim * 1000 AS iron, depth / 1000 AS depth_km FROM "
    "(SELECT DISTINCT library_id, FeT_darwin_clim, depth FROM sample_taxa) x",
)
def _(ws):
    rows = ws.samples.select("library_id", "FeT_darwin_clim", "depth").distinct()
    return rows.withColumns({"iron": F.col("FeT_darwin_clim") * 1000, "depth_km": F.col("depth") / 1000}).drop(
        "FeT_darwin_clim", "depth"
    )


@query("p6_select_name_list", "SELECT library_id, section_id, depth_m FROM experiment_metadata")
def _(ws):
    return select_unique(ws["experiment_metadata"], ["library_id", "section_id", "depth_m", "section_id"])


@query(
    "p7_select_by_type",
    "SELECT latitude_decimal_deg_n, longitude_decimal_deg_w, depth_m, temperature_deg_c, phosphate_bottle_umol_l, "
    "nitrate_nitrite_bottle_umol_l, ctd_station_no FROM experiment_metadata",
)
def _(ws):
    df = ws["experiment_metadata"]
    return df.select(*numeric_columns(df))


@query(
    "p8_transform_by_type",
    "SELECT DENSE_RANK() OVER (ORDER BY section_id) AS section_id, DENSE_RANK() OVER (ORDER BY sample_method) AS "
    "sample_method, DENSE_RANK() OVER (ORDER BY platform_strategy) AS platform_strategy, depth_m FROM experiment_metadata",
)
def _(ws):
    df = ws["experiment_metadata"].select("section_id", "sample_method", "platform_strategy", "depth_m")
    return with_codes(df, text_columns(df))


@query(
    "p9_column_range",
    "SELECT depth_m, section_id, temperature_deg_c, phosphate_bottle_umol_l FROM experiment_metadata",
)
def _(ws):
    return column_range(ws["experiment_metadata"], "depth_m", "phosphate_bottle_umol_l")


@query(
    "p10_split_column",
    "SELECT library_id, SPLIT_PART(iso_datetime_utc, 'T', 1) AS day, "
    "TRY_CAST(SPLIT_PART(iso_datetime_utc, 'T', 1) AS DATE) AS collection_date FROM experiment_metadata",
)
def _(ws):
    return ws["experiment_metadata"].select(
        "library_id",
        first_token("iso_datetime_utc", "T").alias("day"),
        date_part("iso_datetime_utc").alias("collection_date"),
    )


@query(
    "p11_clean_names",
    "SELECT library_id, NO3_darwin_clim AS no3_darwin_clim, FeT_darwin_clim AS fe_t_darwin_clim, depth AS total_reads, "
    "lat AS total_reads_2, lon AS c13_5_a13_5, temperature AS dop_darwin FROM sample_taxa",
)
def _(ws):
    return with_clean_names(
        ws.samples.select(
            "library_id", "NO3_darwin_clim", "FeT_darwin_clim", F.col("depth").alias("Total Reads"),
            F.col("lat").alias("total.reads"), F.col("lon").alias("C13.5/A13.5"), F.col("temperature").alias("DOPDarwin"),
        )
    )


@query(
    "p13_pull_column",
    "SELECT library_id, section_id FROM experiment_metadata WHERE section_id IN "
    "(SELECT section_id FROM experiment_metadata GROUP BY section_id HAVING MIN(latitude_decimal_deg_n) < -89)",
)
def _(ws):
    df = ws["experiment_metadata"]
    lowest = df.groupBy("section_id").agg(F.min("latitude_decimal_deg_n").alias("lat"))
    sections = pull(lowest.filter(F.col("lat") < -89), "section_id")
    return df.filter(F.col("section_id").isin(sections)).select("library_id", "section_id")


@query(
    "p14_row_number_column",
    "SELECT name, n, ROW_NUMBER() OVER (ORDER BY n DESC, name DESC) AS rowname FROM "
    "(SELECT name, COUNT(*) AS n FROM family_bracken_summary GROUP BY name) x",
)
def _(ws):
    counts = ws["family_bracken_summary"].groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, ["n", "name"], descending=True, name="rowname")


# --- filters -----------------------------------------------------------------------------------


@query("f1_threshold", "SELECT * FROM family_bracken_summary WHERE fraction_total_reads > 0.2")
def _(ws):
    return above(ws["family_bracken_summary"], "fraction_total_reads", 0.2)


@query("f2_equality", "SELECT * FROM species_bracken_summary WHERE name = 'hot ring'")
def _(ws):
    return ws["species_bracken_summary"].filter(F.col("name") == "hot ring")


@query("f3_exclusion", f"SELECT * FROM family_bracken_summary WHERE name <> '{CONTAMINANT_FAMILY}'")
def _(ws):
    return without_taxon(ws["family_bracken_summary"], CONTAMINANT_FAMILY)


@query(
    "f4_ranges",
    "SELECT biosample_id, taxon_name, col_date, depth, temperature FROM working WHERE "
    "col_date BETWEEN DATE '1992-03-01' AND DATE '1993-06-30' AND depth BETWEEN 8 AND 120 AND temperature BETWEEN 0 AND 15",
)
def _(ws):
    spec = FilterSpec(
        dates=(datetime.date(1992, 3, 1), datetime.date(1993, 6, 30)), depth=(8.0, 120.0), temperature=(0.0, 15.0)
    )
    return apply_filters(ws.working, spec).select("biosample_id", "taxon_name", "col_date", "depth", "temperature")


@query(
    "f5_membership",
    "SELECT library_id, section_id FROM experiment_metadata WHERE section_id IN ('P18', 'AMT28') AND library_id IN "
    "(SELECT CONCAT('L', c_custkey) FROM customer WHERE c_custkey BETWEEN 0 AND 1499)",
)
def _(ws):
    rows = ws["experiment_metadata"].select("library_id", "section_id").filter(F.col("section_id").isin("P18", "AMT28"))
    return keep_members(rows, "library_id", [f"L{i}" for i in range(1500)])


FILTER = FilterSpec(
    dates=(datetime.date(1992, 1, 1), datetime.date(1997, 12, 31)),
    sections=["AE1319", "AMT28", "C13.5/A13.5", "I07N", "P18"],
    methods=["CTD", "underway"],
    taxa=[f"Brand#{i}" for i in range(1, 21)],
    reads_percent=(0, 60),
    depth=(0.0, 180.0),
    temperature=(-1.0, 26.0),
)
FILTER_SQL = (
    "col_date BETWEEN DATE '1992-01-01' AND DATE '1997-12-31' "
    "AND section_id IN ('AE1319', 'AMT28', 'C13.5/A13.5', 'I07N', 'P18') AND sample_method IN ('CTD', 'underway') "
    "AND taxon_name IN (" + ", ".join(f"'Brand#{i}'" for i in range(1, 21)) + ") "
    "AND fraction_total_reads BETWEEN 0 AND 0.6 AND depth BETWEEN 0 AND 180 AND temperature BETWEEN -1 AND 26"
)


@query("f6_conjunction", f"SELECT * FROM working WHERE {FILTER_SQL}")
def _(ws):
    return apply_filters(ws.working, FILTER)


@query(
    "f7_default_bounds",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, MIN(col_date) AS date_min, MAX(col_date) AS date_max, "
        f"{low} AS reads_percent_min, {high} AS reads_percent_max, MIN(depth) AS depth_min, MAX(depth) AS depth_max, "
        f"MIN(temperature) AS temperature_min, MAX(temperature) AS temperature_max FROM working"
        for kind, low, high in (
            ("exact", "MIN(fraction_total_reads) * 100", "MAX(fraction_total_reads) * 100"),
            (
                "whole",
                "FLOOR(MIN(fraction_total_reads) * 100 + 0.5)",
                "FLOOR(MAX(fraction_total_reads) * 100 + 0.5)",
            ),
        )
    ),
)
def _(ws):
    exact = default_bounds(ws.working).withColumn("kind", F.lit("exact"))
    return exact.unionByName(default_bounds(ws.working, reference_bounds=True).withColumn("kind", F.lit("whole")))


@query("f8_absolute_threshold", "SELECT library_id, temperature_deg_c FROM experiment_metadata WHERE ABS(temperature_deg_c) > 9.5")
def _(ws):
    return above(ws["experiment_metadata"].select("library_id", "temperature_deg_c"), "temperature_deg_c", 9.5, absolute=True)


@query(
    "f9_group_maximum_rows",
    "SELECT experiment_id, name, fraction_total_reads FROM family_bracken_summary f WHERE fraction_total_reads = "
    "(SELECT MAX(g.fraction_total_reads) FROM family_bracken_summary g WHERE g.experiment_id = f.experiment_id)",
)
def _(ws):
    return group_maximum(
        ws["family_bracken_summary"].select("experiment_id", "name", "fraction_total_reads"),
        ["experiment_id"], "fraction_total_reads",
    )


@query(
    "f10_column_pattern",
    "SELECT name, COUNT(*) AS n FROM family_bracken_summary WHERE REGEXP_MATCHES('Brand#13', name) GROUP BY name",
)
def _(ws):
    rows = ws["family_bracken_summary"].filter(subject_matches("Brand#13", "name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# --- joins -------------------------------------------------------------------------------------


@query(
    "j1_left_join",
    "SELECT m.library_id, m.sra_accession_number, r.experiment_accession, r.run_accession FROM experiment_metadata m "
    "LEFT JOIN id_mapping r ON m.sra_accession_number = r.sample_accession",
)
def _(ws):
    runs = ws["id_mapping"].select("sample_accession", "experiment_accession", "run_accession")
    samples = ws["experiment_metadata"].select("library_id", "sra_accession_number")
    return left_join(samples, runs, {"sra_accession_number": "sample_accession"})


@query(
    "j2_join_aggregated",
    "SELECT r.run_accession, r.experiment_accession, n.family_number FROM id_mapping r LEFT JOIN "
    "(SELECT experiment_id, COUNT(*) AS family_number FROM family_bracken_summary GROUP BY experiment_id) n "
    "ON r.experiment_accession = n.experiment_id",
)
def _(ws):
    runs = ws["id_mapping"].select("run_accession", "experiment_accession")
    counts = taxon_counts(ws["family_bracken_summary"], "family_number")
    return left_join(runs, counts, {"experiment_accession": "experiment_id"})


@query(
    "j3_join_leading",
    "SELECT r.run_accession, r.experiment_accession, f.name AS top1_family_name, "
    "f.fraction_total_reads AS top1_family_fraction_total_reads FROM id_mapping r LEFT JOIN "
    "(SELECT * FROM (SELECT *, MAX(fraction_total_reads) OVER (PARTITION BY experiment_id) AS top "
    f"FROM family_bracken_summary WHERE name <> '{CONTAMINANT_FAMILY}') x WHERE fraction_total_reads = top) f "
    "ON r.experiment_accession = f.experiment_id",
)
def _(ws):
    runs = ws["id_mapping"].select("run_accession", "experiment_accession")
    leading = leading_taxa(ws["family_bracken_summary"], CONTAMINANT_FAMILY, "family")
    return left_join(runs, leading, {"experiment_accession": "experiment_id"})


@query(
    "j4_join_many",
    "SELECT r.run_accession, f.experiment_id IS NOT NULL AS matched, f.name, f.fraction_total_reads FROM id_mapping r "
    "LEFT JOIN (SELECT * FROM species_bracken_summary WHERE fraction_total_reads > 0.05) f "
    "ON r.experiment_accession = f.experiment_id",
)
def _(ws):
    taxa = above(ws["species_bracken_summary"], "fraction_total_reads", 0.05).drop("sample_id")
    runs = ws["id_mapping"].select("run_accession", "experiment_accession")
    joined = left_join_many(runs, taxa, {"experiment_accession": "experiment_id"})
    return joined.withColumn("matched", F.col("name").isNotNull()).drop("experiment_accession")


@query(
    "j5_join_by_experiment",
    "SELECT r.run_accession, s.read_count, s.study_accession, t.read_count AS strict_read_count FROM id_mapping r "
    "LEFT JOIN samplesheet s ON r.experiment_accession = s.experiment_accession "
    "LEFT JOIN samplesheet t ON r.experiment_accession = t.experiment_accession AND r.run_accession = t.run_accession",
)
def _(ws):
    runs = ws["id_mapping"].select("run_accession", "experiment_accession")
    sheet = ws["samplesheet"].select("experiment_accession", "read_count", "study_accession")
    by_run = ws["samplesheet"].select("experiment_accession", "run_accession", F.col("read_count").alias("strict_read_count"))
    loose = left_join(runs, sheet, ["experiment_accession"])
    return left_join(loose, by_run, ["experiment_accession", "run_accession"]).drop("experiment_accession")


@query("j6_natural_join", "SELECT w.*, p.lat, p.lon, p.code, p.description FROM climate_wide w LEFT JOIN longhurst p ON w.library_id = p.library_id")
def _(ws):
    wide = widen(ws["climatology"], "variable", "value")
    return natural_left_join(wide, ws["longhurst"])


@query(
    "j7_join_suffixes",
    "SELECT m.library_id, m.lat, m.lon, p.lat AS lat_longhurst, p.lon AS lon_longhurst, p.code FROM "
    "(SELECT library_id, latitude_decimal_deg_n AS lat, longitude_decimal_deg_w AS lon FROM experiment_metadata) m "
    "LEFT JOIN longhurst p ON m.library_id = p.library_id",
)
def _(ws):
    samples = ws["experiment_metadata"].select(
        "library_id", F.col("latitude_decimal_deg_n").alias("lat"), F.col("longitude_decimal_deg_w").alias("lon")
    )
    return left_join(samples, ws["longhurst"].drop("description"), ["library_id"], suffix="_longhurst")


@query(
    "j8_join_same_key",
    "SELECT w.library_id, w.NO3_darwin_clim, m.depth_m FROM climate_wide w LEFT JOIN experiment_metadata m "
    "ON w.library_id = m.library_id",
)
def _(ws):
    wide = widen(ws["climatology"], "variable", "value").select("library_id", "NO3_darwin_clim")
    return left_join(wide, ws["experiment_metadata"].select("library_id", "depth_m"), ["library_id"])


@query(
    "j9_null_safe_join",
    "SELECT m.library_id, m.phosphate_bottle_umol_l AS phosphate, c.n FROM experiment_metadata m LEFT JOIN "
    "(SELECT phosphate_bottle_umol_l AS p, COUNT(*) AS n FROM experiment_metadata GROUP BY phosphate_bottle_umol_l) c "
    "ON m.phosphate_bottle_umol_l IS NOT DISTINCT FROM c.p",
)
def _(ws):
    samples = ws["experiment_metadata"].select("library_id", F.col("phosphate_bottle_umol_l").alias("phosphate"))
    counts = samples.groupBy("phosphate").agg(F.count(F.lit(1)).alias("n"))
    return left_join(samples, counts, ["phosphate"], null_safe=True)


# --- aggregates --------------------------------------------------------------------------------


@query("a1_count_per_group", "SELECT experiment_id, COUNT(*) AS n FROM family_bracken_summary GROUP BY experiment_id")
def _(ws):
    return taxon_counts(ws["family_bracken_summary"], "n")


@query("a2_count_by_keys", "SELECT code, top1_family_name, COUNT(*) AS n FROM sample_taxa GROUP BY code, top1_family_name")
def _(ws):
    return ws.samples.groupBy("code", "top1_family_name").agg(F.count(F.lit(1)).alias("n"))


@query("a3_count_sorted", "SELECT name, COUNT(*) AS n FROM species_bracken_summary GROUP BY name ORDER BY n DESC, name")
def _(ws):
    counts = ws["species_bracken_summary"].groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "name")


@query(
    "a4_distinct_count",
    "SELECT COUNT(DISTINCT code) + COALESCE(MAX(CASE WHEN code IS NULL THEN 1 ELSE 0 END), 0) AS codes, "
    "COUNT(DISTINCT phosphate) + COALESCE(MAX(CASE WHEN phosphate IS NULL THEN 1 ELSE 0 END), 0) AS phosphates FROM sample_taxa",
)
def _(ws):
    return ws.samples.agg(count_distinct_na("code").alias("codes"), count_distinct_na("phosphate").alias("phosphates"))


KEY_FIGURES_SQL = (
    "COUNT(DISTINCT biosample_id) + COALESCE(MAX(CASE WHEN biosample_id IS NULL THEN 1 ELSE 0 END), 0) AS sample_metric, "
    "COUNT(DISTINCT taxon_name) + COALESCE(MAX(CASE WHEN taxon_name IS NULL THEN 1 ELSE 0 END), 0) AS taxon_metric, "
    "COUNT(DISTINCT platform_strategy) + COALESCE(MAX(CASE WHEN platform_strategy IS NULL THEN 1 ELSE 0 END), 0) AS platform_metric, "
    "COUNT(DISTINCT section_id) + COALESCE(MAX(CASE WHEN section_id IS NULL THEN 1 ELSE 0 END), 0) AS section_metric, "
    "CAST(64 AS BIGINT) AS species_metric"
)


@query("a5_key_figures", f"SELECT {KEY_FIGURES_SQL} FROM working")
def _(ws):
    return key_figures(ws.working, 64)


@query(
    "a6_scaled_range",
    "SELECT MIN(fraction_total_reads) * 100 AS min_, MAX(fraction_total_reads) * 100 AS max_, CASE WHEN "
    "COUNT(*) FILTER (temperature IS NULL) = 0 THEN MAX(temperature) END AS max_temperature FROM sample_taxa",
)
def _(ws):
    return ws.samples.agg(
        (F.min("fraction_total_reads") * 100).alias("min_"),
        (F.max("fraction_total_reads") * 100).alias("max_"),
        na_propagating(F.max("temperature"), "temperature", na_propagate=True).alias("max_temperature"),
    )


@query(
    "a7_group_percentage",
    f"SELECT taxon_name, {rounded('CAST(SUM(CAST(fraction_total_reads AS DECIMAL(38,12))) AS DOUBLE) * 100 / COUNT(*)', 6)} "
    "AS percentage FROM sample_taxa GROUP BY taxon_name",
)
def _(ws):
    table = group_percentage(ws.samples, "taxon_name", "fraction_total_reads")
    return table.withColumn("percentage", round_half_up("percentage", 6)).orderBy(F.col("percentage").desc())


@query("a8_distinct_rows", "SELECT DISTINCT biosample_id, section_id, top1_family_name FROM sample_taxa")
def _(ws):
    return ws.samples.select("biosample_id", "section_id", "top1_family_name").distinct()


@query("a9_distinct_values", "SELECT DISTINCT section_id FROM sample_taxa")
def _(ws):
    return ws.samples.select("section_id").distinct()


@query(
    "a10_nest_unnest",
    "SELECT experiment_id, name, fraction_total_reads FROM (SELECT *, RANK() OVER (PARTITION BY experiment_id "
    "ORDER BY fraction_total_reads DESC) AS r FROM family_bracken_summary) x WHERE r <= 3",
)
def _(ws):
    rows = ws["family_bracken_summary"].select("experiment_id", "name", "fraction_total_reads")
    return unnest(nest(top_n_with_ties(rows, ["experiment_id"], "fraction_total_reads", 3), ["experiment_id"]))


@query(
    "a11_ordered_text",
    "SELECT experiment_id, REPLACE(STRING_AGG(name || ': ' || " + percent_sql("fraction_total_reads") + " || '%' || CHR(10), '' "
    "ORDER BY fraction_total_reads DESC, name), ', ', '') AS col2string FROM (SELECT *, RANK() OVER (PARTITION BY experiment_id "
    "ORDER BY fraction_total_reads DESC NULLS LAST) AS r FROM family_bracken_summary) x WHERE r <= 10 GROUP BY experiment_id",
)
def _(ws):
    text = F.concat("name", F.lit(": "), percent_text("fraction_total_reads"), F.lit("%"))
    leading = top_n_with_ties(ws["family_bracken_summary"], ["experiment_id"], "fraction_total_reads", 10)
    return column_to_string(leading.withColumn("line", text), "experiment_id", "line", "fraction_total_reads", "name")


def skewness_sql(column: str, table: str, digits: int = 4) -> str:
    """Population skewness from centred power sums, in SQL."""
    value = (
        "SELECT CASE WHEN MAX(x) > MIN(x) THEN (SUM(POWER(x - m, 3)) / COUNT(x)) / POWER(SUM(POWER(x - m, 2)) / COUNT(x), 1.5) END"
    )
    inner = f"SELECT CAST({column} AS DOUBLE) AS x, (SELECT AVG({column}) FROM {table}) AS m FROM {table}"
    return f"SELECT '{column}' AS feature, {rounded('(' + value + ' FROM (' + inner + ') q)', digits)} AS value"


@query(
    "a12_skewness",
    " UNION ALL ".join(
        skewness_sql(c, "experiment_metadata")
        for c in ("depth_m", "temperature_deg_c", "phosphate_bottle_umol_l", "ctd_station_no")
    ),
)
def _(ws):
    columns = ["depth_m", "temperature_deg_c", "phosphate_bottle_umol_l", "ctd_station_no"]
    return skewness_profile(ws["experiment_metadata"], columns).withColumn("value", round_half_up("value", 4))


@query(
    "a13_missing_fraction",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(COUNT(*) FILTER ({c} IS NULL) AS DOUBLE) / COUNT(*) AS value FROM sample_taxa"
        for c in ("temperature", "phosphate", "nitrate", "code", "taxon_name", "lat")
    ),
)
def _(ws):
    columns = ["temperature", "phosphate", "nitrate", "code", "taxon_name", "lat"]
    return missing_profile(ws.samples, columns).select("feature", F.col("pct_missing").alias("value"))


@query(
    "a14_membership_table",
    "SELECT is_member, COUNT(*) AS n FROM (SELECT sra_accession_number IN (SELECT sample_accession FROM id_mapping) "
    "AS is_member FROM experiment_metadata) x GROUP BY is_member",
)
def _(ws):
    return membership_table(ws["experiment_metadata"], "sra_accession_number", ws["id_mapping"], "sample_accession")


def hexagon_sql(table: str, x: str, y: str, z: str, bins: int = 35) -> str:
    return f"""
WITH hex_range AS (SELECT MIN({x}) AS x0, (MAX({x}) - MIN({x})) / {bins} AS wx, MIN({y}) AS y0,
                          (MAX({y}) - MIN({y})) / {bins} AS wy FROM {table}),
hex_place AS (SELECT (CAST({x} AS DOUBLE) - x0) / wx AS u, (CAST({y} AS DOUBLE) - y0) / wy / SQRT(3.0) AS v,
                     CAST({z} AS DOUBLE) AS z FROM {table}, hex_range WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
hex_near AS (SELECT *, FLOOR(u + 0.5) AS a, FLOOR(v + 0.5) AS b, FLOOR(u) + 0.5 AS c, FLOOR(v) + 0.5 AS d FROM hex_place),
hex_choice AS (SELECT *, (u - a) * (u - a) + (v - b) * (v - b) * 3 <= (u - c) * (u - c) + (v - d) * (v - d) * 3 AS near FROM hex_near)
SELECT CASE WHEN near THEN a ELSE c END AS hex_x, CASE WHEN near THEN b ELSE d END AS hex_y,
       {rounded(exact_avg_sql('z'), 6)} AS mean, COUNT(z) AS n FROM hex_choice GROUP BY 1, 2"""


@query("a15_hexagon_means", hexagon_sql("experiment_metadata", "longitude_decimal_deg_w", "latitude_decimal_deg_n", "depth_m"))
def _(ws):
    means = hexagon_means(ws["experiment_metadata"], "longitude_decimal_deg_w", "latitude_decimal_deg_n", "depth_m")
    return means.withColumn("mean", round_half_up("mean", 6))


# --- windows -----------------------------------------------------------------------------------


@query(
    "w1_group_maximum",
    "SELECT experiment_id, name, fraction_total_reads FROM (SELECT *, MAX(fraction_total_reads) OVER "
    "(PARTITION BY experiment_id) AS top FROM species_bracken_summary) x WHERE fraction_total_reads = top",
)
def _(ws):
    rows = ws["species_bracken_summary"].select("experiment_id", "name", "fraction_total_reads")
    return group_maximum(rows, ["experiment_id"], "fraction_total_reads")


@query(
    "w2_top_n_with_ties",
    "SELECT experiment_id, name, fraction_total_reads FROM (SELECT *, RANK() OVER (PARTITION BY experiment_id "
    "ORDER BY fraction_total_reads DESC NULLS LAST) AS r FROM species_bracken_summary) x WHERE r <= 5",
)
def _(ws):
    rows = ws["species_bracken_summary"].select("experiment_id", "name", "fraction_total_reads")
    return top_n_with_ties(rows, ["experiment_id"], "fraction_total_reads", 5)


@query(
    "w2_top_n_large",
    "SELECT section_id, library_id, temperature_deg_c FROM (SELECT *, RANK() OVER (PARTITION BY section_id "
    "ORDER BY temperature_deg_c DESC NULLS LAST) AS r FROM experiment_metadata) x WHERE r <= 1500",
)
def _(ws):
    rows = ws["experiment_metadata"].select("section_id", "library_id", "temperature_deg_c")
    return top_n_with_ties(rows, ["section_id"], "temperature_deg_c", 1500)


@query(
    "w3_first_of_ties",
    "SELECT name, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY n ORDER BY name) AS r FROM "
    "(SELECT name, COUNT(*) AS n FROM species_bracken_summary GROUP BY name) x) y WHERE r = 1",
)
def _(ws):
    counts = ws["species_bracken_summary"].groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return first_of_ties(counts, "n", "name")


SHARE_SQL = (
    "SELECT depth, taxon_name, n, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY depth) * 100 AS percent FROM "
    "(SELECT depth, taxon_name, COUNT(*) AS n FROM sample_taxa WHERE fraction_total_reads > 0.1 GROUP BY depth, taxon_name) x"
)


@query("w4_share_in_group", f"SELECT depth, taxon_name, n, {rounded('percent', 8)} AS percent FROM ({SHARE_SQL}) s")
def _(ws):
    shares = share_within(above(ws.samples, "fraction_total_reads", 0.1), ["depth"], "taxon_name")
    return shares.withColumn("percent", round_half_up("percent", 8))


@query(
    "w5_cumulative",
    "SELECT model_id, score, n, hits, CAST(SUM(n) OVER w AS BIGINT) AS cum_n, CAST(SUM(hits) OVER w AS BIGINT) AS cum_hits FROM "
    "(SELECT model_id, score, COUNT(*) AS n, CAST(SUM(truth) AS BIGINT) AS hits FROM scored GROUP BY model_id, score) x "
    "WINDOW w AS (PARTITION BY model_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)",
)
def _(ws):
    counts = ws["scored"].groupBy("model_id", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("hits"))
    totals = running_totals(counts, ["model_id"], "score", ["n", "hits"], descending=True)
    return totals.select("model_id", "score", "n", "hits", "cum_n", "cum_hits")


# --- sorts and samples -------------------------------------------------------------------------


@query("t1_sort", "SELECT experiment_id, name, fraction_total_reads FROM family_bracken_summary WHERE fraction_total_reads > 0.1 ORDER BY 3 DESC, 1, 2")
def _(ws):
    rows = above(ws["family_bracken_summary"], "fraction_total_reads", 0.1).drop("sample_id")
    return rows.orderBy(F.col("fraction_total_reads").desc_nulls_last(), "experiment_id", "name")


@query("t2_first_rows", "SELECT library_id, depth_m FROM experiment_metadata ORDER BY depth_m DESC NULLS LAST, library_id LIMIT 20")
def _(ws):
    rows = ws["experiment_metadata"].select("library_id", "depth_m")
    return rows.orderBy(F.col("depth_m").desc_nulls_last(), "library_id").limit(20)


@query("t3_sample_fraction")
def _(ws):
    return ws.samples.sample(0.1, seed=7)


@query(
    "t4_category_order",
    "SELECT section_id, median, ROW_NUMBER() OVER (ORDER BY median, section_id) AS position FROM "
    "(SELECT section_id, QUANTILE_CONT(latitude_decimal_deg_n, 0.5) AS median FROM experiment_metadata GROUP BY section_id) x",
)
def _(ws):
    return category_order(ws["experiment_metadata"], "section_id", "latitude_decimal_deg_n")


@query(
    "t5_appearance_order",
    "SELECT sample_method, first_key, ROW_NUMBER() OVER (ORDER BY first_key DESC, sample_method DESC) AS position FROM "
    "(SELECT sample_method, MIN(library_id) AS first_key FROM experiment_metadata GROUP BY sample_method) x",
)
def _(ws):
    return appearance_order(ws["experiment_metadata"], "sample_method", "library_id", descending=True)


# --- reshaping ---------------------------------------------------------------------------------


@query(
    "r1_bind_rows",
    "SELECT library_id, variable, value, NULL AS code FROM climatology UNION ALL "
    "SELECT library_id, NULL, NULL, code FROM longhurst",
)
def _(ws):
    return bind_rows(*ws.climatologies(), ws["longhurst"].select("library_id", "code"))


@query("r2_widen", "SELECT * FROM climate_wide")
def _(ws):
    return widen(ws["climatology"], "variable", "value")


@query(
    "r3_widen_fill",
    "SELECT library_id, "
    + ", ".join(
        f"CASE WHEN COUNT(*) FILTER (variable = '{v}') = 0 THEN 0.0::DOUBLE ELSE MAX(value) FILTER (variable = '{v}') END AS {v}"
        for v in ("NO3_darwin_clim", "PO4_darwin_clim", "DOP_darwin_clim", "FeT_darwin_clim")
    )
    + " FROM climatology GROUP BY library_id",
)
def _(ws):
    names = ["NO3_darwin_clim", "PO4_darwin_clim", "DOP_darwin_clim", "FeT_darwin_clim"]
    return widen(ws["climatology"], "variable", "value", names=names, fill=0.0)


LONG_SQL = " UNION ALL ".join(
    f"SELECT library_id, '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM experiment_metadata"
    for c in ("section_id", "sample_method", "platform_strategy")
)


@query("r4_lengthen", LONG_SQL)
def _(ws):
    df = ws["experiment_metadata"].select("library_id", "section_id", "sample_method", "platform_strategy")
    return lengthen(df, ["section_id", "sample_method", "platform_strategy"])


@query(
    "r5_lengthen_all",
    " UNION ALL ".join(
        f"SELECT library_id, '{c}' AS key, CAST({c} AS DOUBLE) AS value FROM experiment_metadata"
        for c in ("depth_m", "temperature_deg_c", "ctd_station_no")
    ),
)
def _(ws):
    df = ws["experiment_metadata"].select("library_id", "depth_m", "temperature_deg_c", "ctd_station_no")
    return lengthen(df, name="key", ids=["library_id"], cast="double")


@query(
    "r6_one_wide_row",
    "SELECT "
    + ", ".join(f"MAX(CASE WHEN r = {i} THEN platform_strategy END) AS V{i}" for i in range(1, 6))
    + " FROM (SELECT platform_strategy, ROW_NUMBER() OVER (ORDER BY platform_strategy) AS r FROM "
    "(SELECT DISTINCT platform_strategy FROM experiment_metadata) d) x",
)
def _(ws):
    return one_wide_row(ws["experiment_metadata"], "platform_strategy")


# --- scalar functions --------------------------------------------------------------------------


@query(
    "x1_parse_date",
    "SELECT library_id, TRY_CAST(SUBSTR(iso_datetime_utc, 1, 10) AS DATE) AS day, TRY_CAST(library_id AS DATE) AS bad "
    "FROM experiment_metadata",
)
def _(ws):
    df = ws["experiment_metadata"]
    return df.select("library_id", parse_date(F.left("iso_datetime_utc", F.lit(10))).alias("day"), parse_date("library_id").alias("bad"))


@query("x2_date_text", "SELECT o_orderkey, STRFTIME(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(ws):
    return ws["orders"].select("o_orderkey", date_text("o_orderdate").alias("day"))


@query("x3_truncate_text", "SELECT c_custkey, CASE WHEN LENGTH(c_name) > 16 THEN LEFT(c_name, 13) || '...' ELSE c_name END AS short, "
       "CASE WHEN LENGTH(c_mktsegment) > 9 THEN LEFT(c_mktsegment, 6) || '...' ELSE c_mktsegment END AS segment FROM customer")
def _(ws):
    return ws["customer"].select(
        "c_custkey", truncate_text("c_name", 16).alias("short"), truncate_text("c_mktsegment", 9).alias("segment")
    )


@query(
    "x4_concatenate",
    "SELECT library_id, code || ': ' || taxon_name AS strict_text, COALESCE(code, 'NA') || ': ' || COALESCE(taxon_name, 'NA') "
    "AS loose_text FROM sample_taxa",
)
def _(ws):
    return ws.samples.select(
        "library_id",
        F.concat("code", F.lit(": "), "taxon_name").alias("strict_text"),
        F.concat(or_na_text("code"), F.lit(": "), or_na_text("taxon_name")).alias("loose_text"),
    )


LINKS_SQL = "CASE " + " ".join(
    f"WHEN REGEXP_MATCHES(section_id, '{pattern}') THEN '{text}'" for pattern, text in link_rules()
) + " ELSE section_id END"


@query("x5_first_match", f"SELECT library_id, {LINKS_SQL} AS links FROM experiment_metadata")
def _(ws):
    return ws["experiment_metadata"].select("library_id", first_match("section_id", link_rules()).alias("links"))


@query("x6_recode", "SELECT name, CASE WHEN name = 'Brand#1' THEN 'Brand#1' ELSE 'Other' END AS target, COUNT(*) AS n FROM family_bracken_summary GROUP BY 1, 2")
def _(ws):
    target = F.when(F.col("name") == "Brand#1", F.col("name")).otherwise("Other").alias("target")
    return ws["family_bracken_summary"].groupBy("name", target).agg(F.count(F.lit(1)).alias("n"))


@query("x7_constant_for_missing", "SELECT library_id, COALESCE(temperature_deg_c, 25.73) AS temperature FROM experiment_metadata")
def _(ws):
    return ws["experiment_metadata"].select("library_id", F.coalesce("temperature_deg_c", F.lit(25.73)).alias("temperature"))


@query("x8_clamp", "SELECT library_id, variable, CASE WHEN value < 0 THEN 0.0::DOUBLE ELSE value END AS value FROM climatology")
def _(ws):
    return ws["climatology"].select("library_id", "variable", clamp_negative("value").alias("value"))


@query("x9_convert_unit", "SELECT library_id, value * 1000 AS value FROM climatology WHERE variable = 'FeT_darwin_clim'")
def _(ws):
    iron = ws["climatology"].filter(F.col("variable") == "FeT_darwin_clim")
    return iron.select("library_id", (F.col("value") * 1000).alias("value"))


@query(
    "x10_round_and_percent",
    f"SELECT experiment_id, name, {rounded('fraction_total_reads * 100', 2)} AS percent, "
    f"{percent_sql('fraction_total_reads')} AS percent_text FROM species_bracken_summary",
)
def _(ws):
    return ws["species_bracken_summary"].select(
        "experiment_id", "name",
        round_half_up(F.col("fraction_total_reads") * 100, 2).alias("percent"),
        percent_text("fraction_total_reads").alias("percent_text"),
    )


@query("x11_absolute", "SELECT library_id, ABS(latitude_decimal_deg_n) AS distance FROM experiment_metadata")
def _(ws):
    return ws["experiment_metadata"].select("library_id", F.abs("latitude_decimal_deg_n").alias("distance"))


@query(
    "x12_category_codes",
    "SELECT p.library_id, p.code, CASE WHEN p.code IS NOT NULL THEN c.r END AS code_number FROM "
    "(SELECT m.library_id, l.code FROM experiment_metadata m LEFT JOIN longhurst l ON m.library_id = l.library_id) p "
    "LEFT JOIN (SELECT code, DENSE_RANK() OVER (ORDER BY code) AS r FROM (SELECT DISTINCT code FROM longhurst) d) c ON p.code = c.code",
)
def _(ws):
    df = left_join(ws["experiment_metadata"].select("library_id"), ws["longhurst"].select("library_id", "code"), ["library_id"])
    return left_join(df, dense_codes(ws["longhurst"], [], "code", "code_number"), ["code"])


@query("x13_first_token", "SELECT model_id, SPLIT_PART(model_id, '_', 1) AS model_type, COUNT(*) AS n FROM scored GROUP BY 1, 2")
def _(ws):
    return ws["scored"].groupBy("model_id", first_token("model_id").alias("model_type")).agg(F.count(F.lit(1)).alias("n"))


@query("x14_replace_text", "SELECT doc_id, LENGTH(REPLACE(text, ', ', '')) AS n, REPLACE(source, 'e', '') AS source FROM documents")
def _(ws):
    return ws["documents"].select(
        "doc_id",
        F.length(F.replace("text", F.lit(", "), F.lit(""))).cast("long").alias("n"),
        F.replace("source", F.lit("e"), F.lit("")).alias("source"),
    )


@query("x15_to_number", "SELECT TRY_CAST(SUBSTR(library_id, 2) AS DOUBLE) AS number, TRY_CAST(library_id AS DOUBLE) AS bad FROM experiment_metadata")
def _(ws):
    return ws["experiment_metadata"].select(
        F.expr("try_cast(substr(library_id, 2) AS double)").alias("number"),
        F.col("library_id").try_cast("double").alias("bad"),
    )


@query("x16_sign_label", "SELECT library_id, CASE WHEN temperature_deg_c >= 0 THEN 'Positive' ELSE 'Negative' END AS sign FROM experiment_metadata")
def _(ws):
    return ws["experiment_metadata"].select("library_id", sign_label("temperature_deg_c").alias("sign"))


@query("x17_columns_except", "SELECT * EXCLUDE (temperature_deg_c, library_id) FROM experiment_metadata")
def _(ws):
    df = ws["experiment_metadata"]
    return df.select(*columns_except(df, "temperature_deg_c", "library_id"))


@query("x18_case", "SELECT DISTINCT UPPER(name) AS upper_name, LOWER(name) AS lower_name FROM family_bracken_summary")
def _(ws):
    return ws["family_bracken_summary"].select(F.upper("name").alias("upper_name"), F.lower("name").alias("lower_name")).distinct()


# --- functions of tables -----------------------------------------------------------------------


@query("u1_column_argument", "SELECT section_id AS category, COUNT(*) AS n FROM experiment_metadata GROUP BY section_id")
def _(ws):
    def tally(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))

    return ws["experiment_metadata"].transform(tally, "section_id")


@query(
    "u2_function_per_group",
    "SELECT experiment_id, COUNT(*) AS n, MAX(fraction_total_reads) AS largest FROM species_bracken_summary GROUP BY experiment_id",
)
def _(ws):
    rows = ws["species_bracken_summary"]
    return rows.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"), F.max("fraction_total_reads").alias("largest"))


@query("u3_function_per_column", "SELECT ROUND(MAX(depth_m)) AS depth_m, ROUND(MAX(latitude_decimal_deg_n)) AS latitude_decimal_deg_n FROM experiment_metadata")
def _(ws):
    columns = ["depth_m", "latitude_decimal_deg_n"]
    rounded_rows = map_columns(ws["experiment_metadata"], columns, F.round)
    return rounded_rows.agg(*[F.max(c).alias(c) for c in columns])
