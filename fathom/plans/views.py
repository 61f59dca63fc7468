"""What the interactive views show: the working table, key figures, map points, cruise links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numbers import count_distinct_na, number_text, percent_text
from ..functions.text import first_match, or_na_text, truncate_text
from ..operators.chartdata import hexagon_means
from ..operators.filters import FilterSpec, apply_filters
from ..operators.rank import top_n_with_ties
from ..operators.reshape import one_wide_row

DEFAULT_TEMPERATURE = 25.73
TAXON_NAME_WIDTH = 16
GLOBAL_SPECIES_NUMBER = 16433

# Cruise pattern, shown name, page: fixed values. Patterns are tried in this order.
CRUISES = (
    ("AE1319", "AE1319", "https://www.bco-dmo.org/deployment/537979"),
    ("AMT28", "AMT28", "https://cchdo.ucsd.edu/cruise/74JC20180923"),
    ("BVAL46", "BVAL46", "https://www.bco-dmo.org/dataset/829843"),
    ("C13.5.A13.5", "C13.5/A13.5", "https://cchdo.ucsd.edu/cruise/33RO20200321"),
    ("I07N", "I07N", "https://cchdo.ucsd.edu/cruise/33RO20180423"),
    ("I09N", "I09N", "https://cchdo.ucsd.edu/cruise/33RR20160321"),
    ("NH1418", "NH1418", "https://www.bco-dmo.org/deployment/829909"),
    ("P18", "P18", "https://cchdo.ucsd.edu/cruise/33RO20161119"),
)


def link_rules() -> list[tuple[str, str]]:
    return [(pattern, f'<a target=_blank href="{page}">{name}</a>') for pattern, name, page in CRUISES]


def working_table(samples: DataFrame, rows_per_sample: int | None = None) -> DataFrame:
    """Names cut to width and missing temperatures replaced; of each sample the leading rows, if a number is given."""
    rows = samples.withColumn("taxon_name", truncate_text("taxon_name", TAXON_NAME_WIDTH))
    if rows_per_sample is not None:
        rows = top_n_with_ties(rows, ["biosample_id"], "fraction_total_reads", rows_per_sample)
    return rows.withColumn("temperature", F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE)))


def filtered_view(working: DataFrame, spec: FilterSpec) -> DataFrame:
    """The rows a user asked for, with the link of their cruise."""
    return apply_filters(working, spec).withColumn("links", first_match("section_id", link_rules()))


def key_figures(filtered: DataFrame, species_number: int = GLOBAL_SPECIES_NUMBER) -> DataFrame:
    """Distinct samples, taxa, platforms and sections, and the constant species figure."""
    return filtered.agg(
        count_distinct_na("biosample_id").alias("sample_metric"),
        count_distinct_na("taxon_name").alias("taxon_metric"),
        count_distinct_na("platform_strategy").alias("platform_metric"),
        count_distinct_na("section_id").alias("section_metric"),
        F.lit(species_number).cast("long").alias("species_metric"),
    )


def joined_lines(text: Column, value: Column, tie: Column, within: WindowSpec | None = None) -> Column:
    """All texts of a group, or of a window, largest value first, each followed by a newline; ``, `` is left out."""
    found = F.collect_list(F.struct((-value).alias("v"), tie.alias("t"), text.alias("s")))
    rows = F.sort_array(found if within is None else found.over(within))
    lines = F.array_join(F.transform(rows, lambda r: F.concat(r["s"], F.lit("\n"))), "")
    return F.replace(lines, F.lit(", "), F.lit(""))


def column_to_string(df: DataFrame, group: str, text: str, value: str, tie: str) -> DataFrame:
    """One row per group with its texts in one string, in descending order of ``value``."""
    return df.groupBy(group).agg(joined_lines(F.col(text), F.col(value), F.col(tie)).alias("col2string"))


def map_points(filtered: DataFrame, n: int = 10) -> DataFrame:
    """Map rows: each sample's largest taxa with a hover label listing its n largest."""
    leading = top_n_with_ties(filtered, ["biosample_id"], "fraction_total_reads", n).withColumn(
        "taxon_reads", F.concat("taxon_name", F.lit(": "), percent_text("fraction_total_reads"), F.lit("%"))
    )
    # Rows are dealt by sample for the ranks already; text, largest share and distinct rows need no further shuffle.
    sample = Window.partitionBy("biosample_id")
    text = joined_lines(F.col("taxon_reads"), F.col("fraction_total_reads"), F.col("taxon_name"), sample)
    top = leading.withColumns({"col2string": text, "_largest": F.max("fraction_total_reads").over(sample)})
    top = top.where(F.col("fraction_total_reads") == F.col("_largest")).select(
        *[c for c in leading.columns if c != "biosample_id"], "biosample_id", "col2string"
    )
    top_percent = percent_text("top1_family_fraction_total_reads")
    label = F.concat(
        F.lit("Biosample id: "), or_na_text("biosample_id"),
        F.lit("\nRun accession: "), or_na_text("run_accession"),
        F.lit("\nTotal number of families: "), or_na_text("family_number"),
        F.lit("\nTotal number of species: "), or_na_text("species_number"),
        F.lit("\nTop 1 family: "), or_na_text("top1_family_name"),
        F.lit(": "), F.coalesce(top_percent, F.lit("NA")), F.lit("%"),
        F.lit(f"\n\nNext Top {n} Families, %reads\n{'-' * 37}\n"), or_na_text("col2string"),
    )
    return top.withColumn("label_text", label).distinct()


def cruise_links(filtered: DataFrame) -> DataFrame:
    """The distinct cruise links as one wide row."""
    return one_wide_row(filtered, "links")


def static_map(samples: DataFrame, n: int = 3) -> DataFrame:
    """One row per sample attribute set, the taxon columns dropped, with a short label."""
    leading = top_n_with_ties(samples, ["biosample_id"], "fraction_total_reads", n)
    share = number_text("top1_family_fraction_total_reads", 2)
    label = F.concat("top1_family_name", F.lit(": "), F.coalesce(share, F.lit("NA")), F.lit("%"))
    return leading.withColumn("label_text", label).drop("taxon_name", "fraction_total_reads").distinct()


def species_hexagons(points: DataFrame, bins: int = 35) -> DataFrame:
    return hexagon_means(points, "lon", "lat", "species_number", bins)
