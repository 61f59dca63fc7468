"""The tables that registered queries read, each derived once per session and scale."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.collate import CLIMATOLOGY_VARIABLES, climatology_by_province, collate, enrich, store
from ..plans.views import working_table
from ..session import bound_tasks, materialise, new_path
from ..sources.schemas import SOURCE_SCHEMAS
from ..sources.tables import read_table
from .standins import BASE_TABLES, CONTAMINANT_FAMILY, CONTAMINANT_SPECIES, STAND_INS

_open: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, folder: str) -> "Workspace":
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _open:
        _open[key] = Workspace(spark, key[1])
    return _open[key]


class Workspace:
    """Given tables, source tables derived from them, and the stored result of the collation.

    Derived tables are written to the shared folder the first time they are asked for, as the
    original sources are stored tables too; queries then read them with pushdown.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._derived: dict[str, DataFrame] = {}
        self._kept: dict[str, Any] = {}
        bound_tasks(spark, self["lineitem"].count())

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return read_table(self.spark, f"{self.folder}/{name}.parquet")
        if name not in self._derived:
            self._derived[name] = materialise(self._stand_in(name), name)
        return self._derived[name]

    def keep(self, name: str, build: Callable[[], Any]) -> Any:
        """A model or table that several queries share, built on first use."""
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def _stand_in(self, name: str) -> DataFrame:
        inputs = {t: self[t] for t in (*BASE_TABLES, "family_reads", "species_reads") if _uses(name, t)}
        text = STAND_INS[name]
        for t in inputs:
            text = _replace_word(text, t, "{" + t + "}")
        df = self.spark.sql(text, **inputs)
        schema = SOURCE_SCHEMAS.get(name)
        return df if schema is None else df.to(schema)

    @cached_property
    def collated(self) -> DataFrame:
        return self.collate()

    def collate(self, level: str = "family", strict: bool = False, climatology: DataFrame | None = None) -> DataFrame:
        return collate(
            self["experiment_metadata"], self["id_mapping"], self["family_bracken_summary"],
            self["species_bracken_summary"], self["samplesheet"], level,
            CONTAMINANT_FAMILY, CONTAMINANT_SPECIES, strict, climatology,
        )

    def climatologies(self) -> list[DataFrame]:
        """The climatology as the six single-variable tables it comes in."""
        return [self["climatology"].where(f"variable = '{v}'") for v in CLIMATOLOGY_VARIABLES]

    def climate_province(self) -> DataFrame:
        return climatology_by_province(self.climatologies(), self["longhurst"])

    def enriched(self) -> DataFrame:
        return enrich(self.collated, self.climate_province())

    @cached_property
    def samples(self) -> DataFrame:
        """The stored result table."""
        enriched = self.collate(climatology=self.climate_province())
        paths = {"samples": new_path(self.spark, "samples"), "versions": new_path(self.spark, "versions")}
        store(enriched, self["region"], paths)
        return self.spark.read.schema(enriched.schema).parquet(paths["samples"]).select(*enriched.columns)

    @cached_property
    def working(self) -> DataFrame:
        return materialise(working_table(self.samples), "working")


def _uses(name: str, table: str) -> bool:
    return _replace_word(STAND_INS[name], table, "") != STAND_INS[name]


def _replace_word(text: str, word: str, by: str) -> str:
    return re.sub(rf"(?<=FROM ){word}\b|(?<=JOIN ){word}\b", by, text)
