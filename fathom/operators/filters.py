"""Row filters: one conjunctive predicate built from a specification."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_column

# Above this many values a membership test becomes a semi join instead of a literal list.
LITERAL_LIST_LIMIT = 1000


@dataclass(frozen=True)
class FilterSpec:
    """What a user may narrow. ``None`` leaves a condition out; ranges are inclusive."""

    dates: tuple[datetime.date, datetime.date] | None = None
    sections: Sequence[str] | None = None
    methods: Sequence[str] | None = None
    taxa: Sequence[str] | None = None
    reads_percent: tuple[float, float] | None = None
    depth: tuple[float, float] | None = None
    temperature: tuple[float, float] | None = None


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """All conditions as one predicate, so that the scan can use every part of it."""
    conditions: list[Column] = []
    ranges = {
        "col_date": spec.dates,
        "fraction_total_reads": spec.reads_percent and tuple(b / 100 for b in spec.reads_percent),
        "depth": spec.depth,
        "temperature": spec.temperature,
    }
    for name, bounds in ranges.items():
        if bounds is not None:
            conditions.append(F.col(name).between(F.lit(bounds[0]), F.lit(bounds[1])))
    for name, wanted in {
        "section_id": spec.sections,
        "sample_method": spec.methods,
        "taxon_name": spec.taxa,
    }.items():
        if wanted is None:
            continue
        if len(wanted) <= LITERAL_LIST_LIMIT:
            conditions.append(F.col(name).isin(list(wanted)))
        else:
            df = keep_members(df, name, wanted)
    for c in conditions:
        df = df.filter(c)
    return df


def keep_members(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Membership in a long list, as a semi join that Spark broadcasts only if it is small."""
    listed = df.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], f"`{column}` string")
    return df.join(listed, column, "left_semi")


def default_bounds(df: DataFrame, reference_bounds: bool = False) -> DataFrame:
    """One row with the smallest and largest value that each filter accepts by default.

    ``reference_bounds`` rounds the reads bounds to whole percents, which may leave out the
    largest value; by default they are exact.
    """
    reads_low, reads_high = (F.min("fraction_total_reads") * 100, F.max("fraction_total_reads") * 100)
    if reference_bounds:
        reads_low, reads_high = F.floor(reads_low + 0.5), F.floor(reads_high + 0.5)
    return df.agg(
        F.min("col_date").alias("date_min"),
        F.max("col_date").alias("date_max"),
        reads_low.cast("double").alias("reads_percent_min"),
        reads_high.cast("double").alias("reads_percent_max"),
        F.min("depth").alias("depth_min"),
        F.max("depth").alias("depth_max"),
        F.min("temperature").alias("temperature_min"),
        F.max("temperature").alias("temperature_max"),
    )


def above(df: DataFrame, column: str, threshold: float, absolute: bool = False, inclusive: bool = False) -> DataFrame:
    value = F.abs(as_column(column)) if absolute else as_column(column)
    return df.filter(value >= threshold if inclusive else value > threshold)


def without_taxon(df: DataFrame, contaminant: str, column: str = "name") -> DataFrame:
    """Rows of any other, known taxon: a missing name is dropped too."""
    return df.filter(F.col(column) != contaminant)
