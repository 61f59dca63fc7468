"""Collating profiles, metadata, climatology and provinces into one table, and storing it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp_negative
from ..functions.text import date_part
from ..operators.filters import without_taxon
from ..operators.joins import left_join, left_join_many, natural_left_join
from ..operators.rank import group_maximum
from ..operators.reshape import bind_rows, widen
from ..sources.tables import write_csv, write_store

CONTAMINANT_FAMILY = "Hominidae"
CONTAMINANT_SPECIES = "Homo sapiens"

# source column of the metadata table -> column of the collated table
METADATA_NAMES = {
    "library_id": "library_id",
    "latitude_decimal_deg_n": "lat",
    "longitude_decimal_deg_w": "lon",
    "iso_datetime_utc": "col_date",
    "depth_m": "depth",
    "section_id": "section_id",
    "temperature_deg_c": "temperature",
    "phosphate_bottle_umol_l": "phosphate",
    "nitrate_nitrite_bottle_umol_l": "nitrate",
    "ctd_station_no": "ctd_station",
    "sample_method": "sample_method",
    "platform_strategy": "platform_strategy",
    "sra_accession_number": "biosample_id",
}

CLIMATOLOGY_VARIABLES = (
    "prokaryote_c01_darwin_clim",
    "prokaryote_c02_darwin_clim",
    "NO3_darwin_clim",
    "PO4_darwin_clim",
    "DOP_darwin_clim",
    "FeT_darwin_clim",
)


def taxon_counts(summary: DataFrame, name: str) -> DataFrame:
    """Number of taxa per experiment, the contaminant included."""
    return summary.groupBy("experiment_id").agg(F.count(F.lit(1)).alias(name))


def leading_taxa(summary: DataFrame, contaminant: str, prefix: str) -> DataFrame:
    """The most abundant taxa per experiment, all of them where several tie."""
    clean = without_taxon(summary, contaminant).select("experiment_id", "name", "fraction_total_reads")
    return group_maximum(clean, ["experiment_id"], "fraction_total_reads").select(
        "experiment_id",
        F.col("name").alias(f"top1_{prefix}_name"),
        F.col("fraction_total_reads").alias(f"top1_{prefix}_fraction_total_reads"),
    )


def collate(
    metadata: DataFrame,
    mapping: DataFrame,
    family_summary: DataFrame,
    species_summary: DataFrame,
    samplesheet: DataFrame,
    level: str = "family",
    contaminant_family: str = CONTAMINANT_FAMILY,
    contaminant_species: str = CONTAMINANT_SPECIES,
    strict: bool = False,
    climatology: DataFrame | None = None,
) -> DataFrame:
    """One row per sample, sequencing run, leading family, leading species and taxon.

    All other joins come before that to all taxa, which multiplies rows, so wide rows are never shuffled.
    ``strict`` joins the samplesheet by run as well as by experiment. With ``climatology`` the result is
    what ``enrich`` makes of the collated table, joined while there is still one row per run.
    """
    samples = metadata.select(*[F.col(old).alias(new) for old, new in METADATA_NAMES.items()])
    runs = mapping.select(
        "experiment_accession", "run_accession", "sample_accession", F.col("description").alias("experiment_description")
    )
    by_experiment = {"experiment_accession": "experiment_id"}
    df = left_join(samples, runs, {"biosample_id": "sample_accession"})
    df = left_join(df, taxon_counts(family_summary, "family_number"), by_experiment)
    df = left_join(df, taxon_counts(species_summary, "species_number"), by_experiment)
    df = left_join(df, leading_taxa(family_summary, contaminant_family, "family"), by_experiment)
    df = left_join(df, leading_taxa(species_summary, contaminant_species, "species"), by_experiment)
    sheet = samplesheet.select(
        F.col("experiment_accession").alias("sheet_experiment"),
        F.col("run_accession").alias("sheet_run"),
        "study_accession",
        "instrument_model",
        "read_count",
        "fastq_bytes",
    )
    narrow = df.columns
    if strict:
        df = left_join(df, sheet, {"experiment_accession": "sheet_experiment", "run_accession": "sheet_run"})
    else:
        df = left_join(df, sheet.drop("sheet_run"), {"experiment_accession": "sheet_experiment"})
    if climatology is not None:
        df = enrich(df, climatology)
    summary, contaminant = {
        "family": (family_summary, contaminant_family),
        "species": (species_summary, contaminant_species),
    }[level]
    taxa = without_taxon(summary, contaminant).select(
        F.col("name").alias("taxon_name"), "fraction_total_reads", "experiment_id", "sample_id"
    )
    many = left_join_many(df, taxa, by_experiment)
    return many.select(*narrow, *[c for c in many.columns if c not in df.columns], *df.columns[len(narrow) :])


# Names of the exported files by level: fixed values.
LEVEL_FILES = {"family": "allfam", "species": "allspecies"}


def wide_climatology(tables: Sequence[DataFrame], variables: Sequence[str] = CLIMATOLOGY_VARIABLES) -> DataFrame:
    """The climatology tables one below the other, then one column per variable."""
    united = bind_rows(*[t.select("library_id", "variable", "value") for t in tables])
    return widen(united, "variable", "value", names=variables)


def climatology_by_province(
    tables: Sequence[DataFrame],
    provinces: DataFrame,
    variables: Sequence[str] = CLIMATOLOGY_VARIABLES,
    null_safe: bool = False,
) -> DataFrame:
    return natural_left_join(wide_climatology(tables, variables), provinces, null_safe)


def enrich(collated: DataFrame, climatology: DataFrame, csv_path: str | None = None) -> DataFrame:
    """Dates parsed, climatology and province added, clashing names told apart; optional CSV copy."""
    extra = climatology.withColumnsRenamed(
        {"lat": "lat_longhurst", "lon": "lon_longhurst", "description": "longhurst_description"}
    )
    dated = collated.withColumn("col_date", date_part("col_date"))
    result = left_join(dated, extra, ["library_id"])
    if csv_path:
        write_csv(result, csv_path)
    return result


def export_csv(enriched: DataFrame, climatology: DataFrame, folder: str, level: str = "family") -> dict[str, str]:
    """The enriched table of a level and the wide climatology with its provinces as CSV; where each went."""
    paths = {"composite": f"{folder}/marine_composite_{LEVEL_FILES[level]}", "climatology": f"{folder}/darwin_bound_wide_longhurst"}
    write_csv(enriched, paths["composite"])
    write_csv(climatology, paths["climatology"])
    return paths


def clean_metadata(metadata: DataFrame) -> DataFrame:
    """The metadata columns of interest under short names, with the collection date parsed."""
    return (
        metadata.select(
            "library_id", "latitude_decimal_deg_n", "longitude_decimal_deg_w", "iso_datetime_utc", "depth_m",
            "temperature_deg_c", "phosphate_bottle_umol_l", "nitrate_nitrite_bottle_umol_l", "ctd_station_no",
            "sample_method", "platform_strategy", "sra_accession_number",
        )
        .withColumnsRenamed(
            {
                "latitude_decimal_deg_n": "lat",
                "longitude_decimal_deg_w": "lon",
                "iso_datetime_utc": "collection_date",
                "depth_m": "depth",
                "temperature_deg_c": "temperature",
                "phosphate_bottle_umol_l": "phosphate",
                "nitrate_nitrite_bottle_umol_l": "nitrate_nitrite",
            }
        )
        .withColumn("collection_date", date_part("collection_date"))
    )


def climatology_with_metadata(climatology: DataFrame, metadata: DataFrame) -> DataFrame:
    """Climatology and province per library, with the cleaned metadata of that library."""
    return left_join(climatology.drop("lat", "lon"), clean_metadata(metadata), ["library_id"])


def store(enriched: DataFrame, versions: DataFrame, tables: Mapping[str, str]) -> None:
    """Replace the stored result tables; ``tables`` maps ``samples`` and ``versions`` to paths.

    Samples are stored by cruise section, so that a section filter reads only its files.
    """
    write_store(enriched, tables["samples"], partition_by=["section_id"])
    write_store(versions, tables["versions"])


def analysis_table(enriched: DataFrame) -> DataFrame:
    """The modelling columns: renamed climatology, negatives clamped, iron per kilogram in nmol."""
    plain = [
        "library_id", "lat", "lon", "col_date", "section_id", "depth", "temperature", "phosphate", "nitrate",
        "ctd_station", "sample_method", "platform_strategy", "biosample_id", "experiment_accession",
        "run_accession", "experiment_description", "family_number", "species_number", "top1_family_name",
        "top1_family_fraction_total_reads", "top1_species_name", "top1_species_fraction_total_reads",
    ]
    return enriched.select(
        *plain,
        F.col("taxon_name").alias("topn_family_name"),
        F.col("fraction_total_reads").alias("topn_family_fraction_total_reads"),
        "study_accession", "instrument_model", "read_count", "fastq_bytes",
        clamp_negative("prokaryote_c01_darwin_clim").alias("synDarwin"),
        clamp_negative("prokaryote_c02_darwin_clim").alias("proDarwin"),
        F.col("NO3_darwin_clim").alias("nitrateDarwin"),
        F.col("PO4_darwin_clim").alias("phosphateDarwin"),
        F.col("DOP_darwin_clim").alias("DOPDarwin"),
        "lat_longhurst", "lon_longhurst", "code",
        (F.col("FeT_darwin_clim") * 1000).alias("ironDarwin"),
    )
