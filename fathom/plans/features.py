"""Tables for modelling: widened taxa, targets, the feature recipe, and shares by depth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_names, subject_matches, with_clean_names
from ..operators.chartdata import box_statistics
from ..operators.filters import above, without_taxon
from ..operators.joins import left_join, left_join_many
from ..operators.prep import (
    DropColumns, Dummies, KeepColumns, ModeImpute, NearZeroVariance, NeighbourImpute, Normalise, PowerTransform,
    TargetImpute,
)
from ..operators.profile import columns_to_impute, columns_to_remove, correlated_features, skewed_columns
from ..operators.rank import share_within, top_n_with_ties
from ..operators.reshape import widen
from ..session import materialise

TARGET_FAMILY = "Prochloraceae"

# Columns of the stored table that no model uses.
NOT_MODELLED = (
    "library_id", "sample_id", "instrument_model", "read_count", "top1_family_name",
    "top1_family_fraction_total_reads", "ctd_station", "experiment_accession", "run_accession",
    "experiment_description", "study_accession", "col_date", "fastq_bytes", "lon_longhurst", "lat_longhurst",
)


def leading_rows(samples: DataFrame, n: int = 3) -> DataFrame:
    """The n most abundant taxa of each sample with the modelling columns."""
    return top_n_with_ties(samples, ["biosample_id"], "fraction_total_reads", n).drop(*NOT_MODELLED)


def widened(rows: DataFrame, taxa: Sequence[str] | None = None, species: Sequence[str] | None = None) -> DataFrame:
    """One column per taxon, then one per leading species; absent ones are 0."""
    by_taxon = widen(rows, "taxon_name", "fraction_total_reads", taxa, fill=0.0)
    by_species = widen(by_taxon, "top1_species_name", "top1_species_fraction_total_reads", species, fill=0.0)
    return with_clean_names(by_species)


def regression_table(
    samples: DataFrame, taxa: Sequence[str] | None = None, species: Sequence[str] | None = None, keep_id: bool = False
) -> DataFrame:
    wide = widened(leading_rows(samples), taxa, species)
    return wide if keep_id else wide.drop("biosample_id")


def classification_table(
    samples: DataFrame, taxa: Sequence[str] | None = None, species: Sequence[str] | None = None,
    family: str = TARGET_FAMILY, keep_id: bool = False,
) -> DataFrame:
    """Target: does the leading taxon's name occur in the family's name? Its own share is dropped."""
    top = top_n_with_ties(leading_rows(samples), ["biosample_id"], "fraction_total_reads", 1)
    labelled = top.withColumn("target", F.when(subject_matches(family, "taxon_name"), family).otherwise("Other"))
    wide = widened(labelled, taxa, species).drop(*clean_names([family]))
    return wide if keep_id else wide.drop("biosample_id")


@dataclass
class FeatureRecipe:
    """A fitted recipe: the model that applies it, the columns chosen, and the training rows as prepared."""

    model: PipelineModel
    outcome: str
    key: str
    removed: list[str]
    imputed: list[str]
    skewed: list[str]
    selected: list[str]
    training: DataFrame

    def apply(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_features(
    train: DataFrame, outcome: str, key: str, missing_threshold: float = 0.2, correlation: float = 0.09,
    impute_target: bool = True, neighbour_columns: Sequence[str] | None = None,
) -> FeatureRecipe:
    """Fit the recipe on training rows and choose the features that correlate with the outcome.

    The last stage keeps the chosen columns, and adds those that are absent at scoring time.
    """
    removed = columns_to_remove(train.drop(key, outcome), missing_threshold)
    imputed = columns_to_impute(train, [*removed, key, outcome])
    skewed = skewed_columns(train.drop(key), [outcome, *removed], na_propagate=True)
    exclude = [outcome, key]
    stages = [DropColumns(columns=removed)]
    if impute_target:
        stages.append(TargetImpute(target=outcome, exclude=exclude))
    stages += [
        NeighbourImpute(key=key, exclude=exclude, use=neighbour_columns),
        ModeImpute(exclude=exclude),
        PowerTransform(columns=skewed),
        Normalise(exclude=exclude),
        Dummies(exclude=exclude, one_hot=True),
        NearZeroVariance(exclude=exclude),
    ]
    fitted = []
    baked = train
    for stage in stages:
        model = stage.fit(baked) if isinstance(stage, Estimator) else stage
        baked = model.transform(baked)
        fitted.append(model)
        if isinstance(stage, (TargetImpute, NeighbourImpute, Normalise, NearZeroVariance)):
            # Later stages read the rows several times; the steps so far are not repeated for each.
            baked = materialise(baked, "baked")
    selected = correlated_features(baked.drop(key), outcome, correlation)
    keep = KeepColumns(columns=selected, exclude=exclude)
    fitted.append(keep)
    return FeatureRecipe(
        PipelineModel(fitted), outcome, key, removed, imputed, skewed, selected, keep.transform(baked)
    )


def taxa_with_metadata(metadata: DataFrame, mapping: DataFrame, family_summary: DataFrame) -> DataFrame:
    """Every taxon of every sample with the sample's depth, temperature and nutrients."""
    samples = metadata.select(
        "library_id", "sra_accession_number", F.col("depth_m").alias("depth"), "temperature_deg_c",
        F.col("phosphate_bottle_umol_l").alias("phosphate"),
        F.col("nitrate_nitrite_bottle_umol_l").alias("nitrate_nitrite"),
    )
    runs = mapping.select("sample_accession", "experiment_accession")
    taxa = family_summary.select(F.col("name").alias("tax_name"), "fraction_total_reads", "experiment_id")
    joined = left_join(samples, runs, {"sra_accession_number": "sample_accession"})
    return left_join_many(joined, taxa, {"experiment_accession": "experiment_id"})


def shares_by_depth(rows: DataFrame, threshold: float = 0.2) -> DataFrame:
    return share_within(above(rows, "fraction_total_reads", threshold), ["depth"], "tax_name")


def box_by_taxon(rows: DataFrame, value: str, contaminant: str, threshold: float = 0.01) -> DataFrame:
    kept = without_taxon(above(rows, "fraction_total_reads", threshold), contaminant, "tax_name")
    return box_statistics(kept, ["tax_name"], value)
