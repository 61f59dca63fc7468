"""The composite jobs: collation, store, views, modelling tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..functions.text import clean_names
from ..plans.collate import analysis_table, climatology_with_metadata, enrich, export_csv, store
from ..plans.features import (
    box_by_taxon, classification_table, regression_table, shares_by_depth, taxa_with_metadata,
)
from ..plans.views import cruise_links, filtered_view, key_figures, map_points, species_hexagons, static_map
from ..session import new_path
from ..sources.tables import read_csv
from .profiling import box_sql, rounded_box
from .registry import number_sql, percent_sql, query, rounded
from .relational import FILTER, FILTER_SQL, KEY_FIGURES_SQL, LINKS_SQL, hexagon_sql
from .standins import CONTAMINANT_FAMILY, CONTAMINANT_SPECIES, SPECIES_TOTAL, TARGET_FAMILY

TAXA = [f"Brand#{i}" for i in range(1, 26) if f"Brand#{i}" != CONTAMINANT_FAMILY]
SPECIES = [
    f"{a} {b}"
    for a in "blue cold hot large new old red small".split()
    for b in "anvil bolt gear gizmo plate ring rod widget".split()
    if f"{a} {b}" != CONTAMINANT_SPECIES
]


@query("k1_collate", "SELECT * FROM collated")
def _(ws):
    return ws.collate()


@query(
    "k1_collate_species",
    "SELECT c.library_id, c.run_accession, t.name AS taxon_name, t.fraction_total_reads, c.top1_family_name, s.read_count "
    "FROM (SELECT DISTINCT library_id, experiment_accession, run_accession, top1_family_name, top1_species_name FROM collated) c "
    f"LEFT JOIN (SELECT * FROM species_bracken_summary WHERE name <> '{CONTAMINANT_SPECIES}') t ON c.experiment_accession = t.experiment_id "
    "LEFT JOIN samplesheet s ON c.experiment_accession = s.experiment_accession AND c.run_accession = s.run_accession",
)
def _(ws):
    return ws.collate("species", strict=True).select(
        "library_id", "run_accession", "taxon_name", "fraction_total_reads", "top1_family_name", "read_count"
    )


@query("k2_enrich", "SELECT * FROM sample_taxa")
def _(ws):
    return enrich(ws.collated, ws.climate_province(), csv_path=None)


def _exported(ws):
    def build():
        climate = ws.climate_province()
        return climate.schema, export_csv(ws.samples, climate, new_path(ws.spark, "export"))

    return ws.keep("exported", build)


@query("k2_csv_composite", "SELECT * FROM sample_taxa")
def _(ws):
    """The first export, read back."""
    _, paths = _exported(ws)
    return read_csv(ws.spark, paths["composite"], ws.samples.schema)


@query("k2_csv_climatology", "SELECT * FROM climate_province")
def _(ws):
    """The second export, read back."""
    schema, paths = _exported(ws)
    return read_csv(ws.spark, paths["climatology"], schema)


@query("k3_store", "SELECT section_id, COUNT(*) AS n, MIN(col_date) AS first_day, MAX(col_date) AS last_day FROM sample_taxa GROUP BY section_id")
def _(ws):
    paths = {"samples": new_path(ws.spark, "samples"), "versions": new_path(ws.spark, "versions")}
    store(ws.samples, ws["region"], paths)
    stored = ws.spark.read.schema(ws.samples.schema).parquet(paths["samples"])
    return stored.groupBy("section_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("col_date").alias("first_day"), F.max("col_date").alias("last_day")
    )


MAP_SQL = f"""
WITH mp_rows AS (SELECT *, {LINKS_SQL} AS links FROM working WHERE {FILTER_SQL}),
mp_top AS (SELECT * EXCLUDE (r), taxon_name || ': ' || {percent_sql('fraction_total_reads')} || '%' AS taxon_reads FROM
  (SELECT *, RANK() OVER (PARTITION BY biosample_id ORDER BY fraction_total_reads DESC NULLS LAST) AS r FROM mp_rows) x WHERE r <= 5),
mp_text AS (SELECT biosample_id, MAX(fraction_total_reads) AS largest,
  REPLACE(STRING_AGG(taxon_reads || CHR(10), '' ORDER BY fraction_total_reads DESC, taxon_name), ', ', '') AS col2string
  FROM mp_top GROUP BY biosample_id)
SELECT DISTINCT t.*, m.col2string, 'Biosample id: ' || COALESCE(t.biosample_id, 'NA') || CHR(10) || 'Run accession: ' || COALESCE(t.run_accession, 'NA')
  || CHR(10) || 'Total number of families: ' || COALESCE(CAST(t.family_number AS VARCHAR), 'NA')
  || CHR(10) || 'Total number of species: ' || COALESCE(CAST(t.species_number AS VARCHAR), 'NA')
  || CHR(10) || 'Top 1 family: ' || COALESCE(t.top1_family_name, 'NA') || ': ' || COALESCE({percent_sql('t.top1_family_fraction_total_reads')}, 'NA') || '%'
  || CHR(10) || CHR(10) || 'Next Top 5 Families, %reads' || CHR(10) || '{'-' * 37}' || CHR(10) || COALESCE(m.col2string, 'NA') AS label_text
FROM mp_top t JOIN mp_text m ON t.biosample_id IS NOT DISTINCT FROM m.biosample_id AND t.fraction_total_reads = m.largest"""


@query("k4_map_points", MAP_SQL)
def _(ws):
    return map_points(filtered_view(ws.working, FILTER), 5)


@query("k5_key_figures", f"SELECT {KEY_FIGURES_SQL} FROM working WHERE {FILTER_SQL}")
def _(ws):
    return key_figures(filtered_view(ws.working, FILTER), SPECIES_TOTAL)


@query(
    "k6_cruise_links",
    "SELECT "
    + ", ".join(f"MAX(CASE WHEN r = {i} THEN links END) AS V{i}" for i in range(1, 6))
    + f" FROM (SELECT links, ROW_NUMBER() OVER (ORDER BY links) AS r FROM (SELECT DISTINCT {LINKS_SQL} AS links FROM working WHERE {FILTER_SQL}) d) x",
)
def _(ws):
    return cruise_links(filtered_view(ws.working, FILTER))


@query(
    "k7_analysis_table",
    "SELECT library_id, lat, lon, col_date, section_id, depth, temperature, phosphate, nitrate, ctd_station, sample_method, "
    "platform_strategy, biosample_id, experiment_accession, run_accession, experiment_description, family_number, species_number, "
    "top1_family_name, top1_family_fraction_total_reads, top1_species_name, top1_species_fraction_total_reads, "
    "taxon_name AS topn_family_name, fraction_total_reads AS topn_family_fraction_total_reads, study_accession, instrument_model, "
    "read_count, fastq_bytes, CASE WHEN prokaryote_c01_darwin_clim < 0 THEN 0 ELSE prokaryote_c01_darwin_clim END AS synDarwin, "
    "CASE WHEN prokaryote_c02_darwin_clim < 0 THEN 0 ELSE prokaryote_c02_darwin_clim END AS proDarwin, NO3_darwin_clim AS nitrateDarwin, "
    "PO4_darwin_clim AS phosphateDarwin, DOP_darwin_clim AS DOPDarwin, lat_longhurst, lon_longhurst, code, FeT_darwin_clim * 1000 AS ironDarwin "
    "FROM sample_taxa",
)
def _(ws):
    return analysis_table(ws.samples)


MODEL_IDS = (
    "lat, lon, depth, section_id, temperature, phosphate, nitrate, sample_method, platform_strategy, family_number, species_number, "
    "prokaryote_c01_darwin_clim, prokaryote_c02_darwin_clim, NO3_darwin_clim AS no3_darwin_clim, PO4_darwin_clim AS po4_darwin_clim, "
    "DOP_darwin_clim AS dop_darwin_clim, FeT_darwin_clim AS fe_t_darwin_clim, code, longhurst_description"
)


def _cells(names, column, value, skip=()):
    return ", ".join(
        f"COALESCE(MAX(CASE WHEN {column} = '{n}' THEN {value} END), 0) AS {c}"
        for n, c in zip(names, clean_names(names))
        if n not in skip
    )


def wide_sql(source: str, extra: str = "", skip=()) -> str:
    group = "GROUP BY ALL"
    return (
        f"SELECT * EXCLUDE (biosample_id) FROM (SELECT biosample_id, {MODEL_IDS}{extra}, {_cells(TAXA, 'taxon_name', 'fraction_total_reads', skip)}, "
        f"{_cells(SPECIES, 'top1_species_name', 'top1_species_fraction_total_reads')} FROM {source} {group}) w"
    )


TOP_SQL = (
    "(SELECT * FROM (SELECT *, RANK() OVER (PARTITION BY biosample_id ORDER BY fraction_total_reads DESC NULLS LAST) AS r "
    "FROM sample_taxa) x WHERE r <= {n}) t"
)


@query("k8_regression_table", wide_sql(TOP_SQL.format(n=3)))
def _(ws):
    return regression_table(ws.samples, TAXA, SPECIES)


@query(
    "k9_classification_table",
    wide_sql(
        f"(SELECT *, CASE WHEN REGEXP_MATCHES('{TARGET_FAMILY}', taxon_name) THEN '{TARGET_FAMILY}' ELSE 'Other' END AS target FROM {TOP_SQL.format(n=1)}) u",
        ", target",
        skip=(TARGET_FAMILY,),
    ),
)
def _(ws):
    return classification_table(ws.samples, TAXA, SPECIES, TARGET_FAMILY)


TAXA_METADATA_SQL = (
    "(SELECT m.depth_m AS depth, m.temperature_deg_c, f.name AS tax_name, f.fraction_total_reads FROM experiment_metadata m "
    "LEFT JOIN id_mapping r ON m.sra_accession_number = r.sample_accession "
    "LEFT JOIN family_bracken_summary f ON r.experiment_accession = f.experiment_id) tm"
)


def _taxa(ws):
    return taxa_with_metadata(ws["experiment_metadata"], ws["id_mapping"], ws["family_bracken_summary"])


@query(
    "k12_share_by_depth",
    f"SELECT depth, tax_name, n, {rounded('CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY depth) * 100', 8)} AS percent FROM "
    f"(SELECT depth, tax_name, COUNT(*) AS n FROM {TAXA_METADATA_SQL} WHERE fraction_total_reads > 0.1 GROUP BY depth, tax_name) x",
)
def _(ws):
    return shares_by_depth(_taxa(ws), 0.1).withColumn("percent", round_half_up("percent", 8))


@query(
    "k12_box_by_taxon",
    box_sql(
        f"(SELECT * FROM {TAXA_METADATA_SQL} WHERE fraction_total_reads > 0.01 AND tax_name <> '{CONTAMINANT_FAMILY}')",
        "tax_name", "temperature_deg_c",
    ),
)
def _(ws):
    return rounded_box(box_by_taxon(_taxa(ws), "temperature_deg_c", CONTAMINANT_FAMILY))


@query(
    "k13_climatology_metadata",
    "SELECT w.* EXCLUDE (lat, lon), m.latitude_decimal_deg_n AS lat, m.longitude_decimal_deg_w AS lon, "
    "TRY_CAST(SPLIT_PART(m.iso_datetime_utc, 'T', 1) AS DATE) AS collection_date, m.depth_m AS depth, m.temperature_deg_c AS temperature, "
    "m.phosphate_bottle_umol_l AS phosphate, m.nitrate_nitrite_bottle_umol_l AS nitrate_nitrite, m.ctd_station_no, m.sample_method, "
    "m.platform_strategy, m.sra_accession_number FROM climate_province w LEFT JOIN experiment_metadata m ON w.library_id = m.library_id",
)
def _(ws):
    return climatology_with_metadata(ws.climate_province(), ws["experiment_metadata"])


STATIC_SQL = (
    "SELECT DISTINCT * EXCLUDE (taxon_name, fraction_total_reads, r), top1_family_name || ': ' || COALESCE("
    + number_sql(rounded("top1_family_fraction_total_reads", 2))
    + f", 'NA') || '%' AS label_text FROM {TOP_SQL.format(n=3)}"
)


@query("k14_static_map", STATIC_SQL)
def _(ws):
    return static_map(ws.samples)


@query("k14_species_hexagons", hexagon_sql(f"({STATIC_SQL}) st", "lon", "lat", "species_number"))
def _(ws):
    return species_hexagons(static_map(ws.samples)).withColumn("mean", round_half_up("mean", 6))
