"""Declared schemas of the source tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(columns: str) -> T.StructType:
    schema = T.StructType()
    for column in columns.split(","):
        schema = schema.add(*column.split())
    return schema


EXPERIMENT_METADATA = _schema(
    "library_id string, latitude_decimal_deg_n double, longitude_decimal_deg_w double, "
    "iso_datetime_utc string, depth_m double, section_id string, temperature_deg_c double, "
    "phosphate_bottle_umol_l double, nitrate_nitrite_bottle_umol_l double, ctd_station_no long, "
    "sample_method string, platform_strategy string, sra_accession_number string"
)
ID_MAPPING = _schema(
    "experiment_accession string, run_accession string, sample_accession string, description string"
)
TAXON_SUMMARY = _schema("name string, fraction_total_reads double, experiment_id string, sample_id string")
SAMPLESHEET = _schema(
    "experiment_accession string, accession string, run_accession string, study_accession string, "
    "instrument_model string, read_count long, fastq_bytes string"
)
CLIMATOLOGY = _schema("library_id string, variable string, value double")
PROVINCE = _schema("library_id string, lat double, lon double, code string, description string")
SCORING_ROW = _schema("lat double, section_id_AMT28 double, section_id_P18 double, dop_darwin_clim double")

SOURCE_SCHEMAS = {
    "experiment_metadata": EXPERIMENT_METADATA,
    "id_mapping": ID_MAPPING,
    "family_bracken_summary": TAXON_SUMMARY,
    "species_bracken_summary": TAXON_SUMMARY,
    "samplesheet": SAMPLESHEET,
    "climatology": CLIMATOLOGY,
    "longhurst": PROVINCE,
}
