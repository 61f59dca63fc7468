"""A recipe fitted inside every fold at once, with steps that touch training rows only.

The training rows of a fold are all rows outside it. One pass takes level counts and numeric moments per
fold; the statistics of a fold's training rows are put together from those of the other folds, so rows are
never read once per fold. ``prepared`` then gives every row once for each fold, as training or as
assessment row, each completed and recoded by what that fold's training rows say. ``balanced`` adds
synthetic rows to the training rows of all folds in one neighbour search; assessment rows stay as they are.

Steps, in order: unseen and rare categories become ``other``, missing ones ``unknown``, missing numbers the
training mean; categories become 0/1 columns, and what is constant in a fold's training rows becomes 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import names_sql, quoted, text_literal
from .prep import dummy_name, smote

OTHER, UNKNOWN = "other", "unknown"


@dataclass
class FoldRecipe:
    """What the training rows of each fold say: means, spreads and kept levels, one entry per fold."""

    folds: int
    outcome: str
    key: str
    fold: str
    numeric: list[str]
    text: list[str]
    means: dict[str, list[float | None]]
    deviations: dict[str, list[float | None]]
    constant: dict[str, list[bool]]
    levels: dict[str, list[list[str]]]

    def statistics(self, spark) -> DataFrame:
        """split_id, feature, mean, deviation of numbers; levels of categories, joined by commas."""
        rows = []
        for i in range(self.folds):
            rows += [(i, c, self.means[c][i], self.deviations[c][i], None) for c in self.numeric]
            rows += [(i, c, None, None, ",".join(self.levels[c][i])) for c in self.text]
        return spark.createDataFrame(rows, "split_id int, feature string, mean double, deviation double, levels string")

    def _dummies(self) -> dict[str, tuple[str, str]]:
        """Name of each 0/1 column: its category and level. Any fold's levels; the same columns in all folds."""
        made: dict[str, tuple[str, str]] = {}
        for c in self.text:
            for level in sorted({v for found in self.levels[c] for v in found} | {OTHER, UNKNOWN}):
                name = dummy_name(c, level)
                while name in made:
                    name += "_"
                made[name] = (c, level)
        return made

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self._dummies()]

    def prepared(self, df: DataFrame) -> DataFrame:
        """Every row for every fold: key, outcome, ``split_id``, ``part`` and the features."""
        split = F.explode(F.sequence(F.lit(0), F.lit(self.folds - 1)))
        rows = df.withColumn("split_id", split)
        part = F.when(quoted(self.fold) == F.col("split_id"), "Assessment").otherwise("Analysis")
        own = lambda values: F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col("split_id"))
        numbers = [
            F.when(F.get(F.array(*[F.lit(b) for b in self.constant[c]]), F.col("split_id")), 0.0)
            .otherwise(F.coalesce(quoted(c).cast("double"), own(self.means[c]))).alias(c)
            for c in self.numeric
        ]
        coded = {}
        for c in self.text:
            lists = ", ".join("array(" + ", ".join(map(text_literal, found)) + ")" if found else "CAST(array() AS array<string>)" for found in self.levels[c])
            kept = F.array_contains(F.get(F.expr(f"array({lists})"), F.col("split_id")), quoted(c))
            coded[c] = F.when(quoted(c).isNull(), UNKNOWN).when(kept, quoted(c)).otherwise(OTHER)
        flags = [(coded[c] == F.lit(level)).cast("double").alias(name) for name, (c, level) in self._dummies().items()]
        return rows.select(quoted(self.key), quoted(self.outcome), "split_id", part.alias("part"), *numbers, *flags)

    def balanced(self, df: DataFrame, over_ratio: float = 1.0, neighbours: int = 5, seed: int = 1) -> DataFrame:
        """``prepared`` with synthetic training rows, marked ``synthetic``; no fold's assessment rows are used or added to."""
        ready = self.prepared(df)
        training = smote(
            ready.where("part = 'Analysis'"), self.outcome, self.key, over_ratio, neighbours, seed, self.features, group="split_id"
        )
        rest = ready.where("part = 'Assessment'").withColumn(self.key, quoted(self.key).cast("string"))
        training = training.withColumn("part", F.lit("Analysis"))
        return training.unionByName(rest.withColumn("synthetic", F.lit(False)), allowMissingColumns=True)


def fit_fold_recipe(
    df: DataFrame, outcome: str, key: str, numeric: Sequence[str], text: Sequence[str], folds: int, fold: str = "fold",
    threshold: float = 0.01,
) -> FoldRecipe:
    """The recipe of every fold: one aggregate for numbers, one for categories.

    A level is kept in a fold if it makes up ``threshold`` of the known values of its training rows. A number
    that no training row has stays missing.
    """
    numeric, text = list(numeric), list(text)
    means: dict[str, list] = {c: [] for c in numeric}
    deviations: dict[str, list] = {c: [] for c in numeric}
    constant: dict[str, list[bool]] = {c: [] for c in numeric}
    if numeric:
        measures = []
        for i, c in enumerate(numeric):
            x = quoted(c).cast("double")
            measures += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        found = {r[fold]: r for r in df.groupBy(fold).agg(*measures).collect()}
        for i, c in enumerate(numeric):
            for held in range(folds):
                rest = [r for f, r in sorted(found.items()) if f != held and r[f"n{i}"]]
                n = sum(r[f"n{i}"] for r in rest)
                mean = sum(r[f"n{i}"] * r[f"m{i}"] for r in rest) / n if n else None
                squares = sum(r[f"n{i}"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in rest)
                means[c].append(mean)
                deviations[c].append((squares / (n - 1)) ** 0.5 if n > 1 else None)
                constant[c].append(bool(rest) and min(r[f"l{i}"] for r in rest) == max(r[f"h{i}"] for r in rest))
    levels: dict[str, list[list[str]]] = {c: [[] for _ in range(folds)] for c in text}
    if text:
        cells = df.select(quoted(fold).alias(fold), *[quoted(c) for c in text]).unpivot([fold], names_sql(text), "feature", "value")
        cells = cells.where(F.col("value").isNotNull())
        counts = cells.groupBy("feature", "value").agg(
            F.count("*").alias("n"), *[F.count_if(F.col(fold) == i).alias(f"n{i}") for i in range(folds)]
        )
        sizes = counts.groupBy(F.col("feature").alias("_feature")).agg(
            *[F.sum(F.col("n") - F.col(f"n{i}")).alias(f"all{i}") for i in range(folds)]
        )
        share = lambda i: F.try_divide(F.col("n") - F.col(f"n{i}"), F.col(f"all{i}"))
        kept = F.filter(F.array(*[F.when(share(i) >= threshold, F.lit(i)) for i in range(folds)]), lambda x: x.isNotNull())
        # In each fold no more than 1 / threshold levels of a column can reach the threshold.
        table = counts.join(sizes, F.col("feature") == F.col("_feature")).select("feature", "value", kept.alias("kept"))
        for r in table.where(F.size("kept") > 0).orderBy("feature", "value").collect():
            for i in r.kept:
                levels[r.feature][i].append(r.value)
    return FoldRecipe(folds, outcome, key, fold, numeric, text, means, deviations, constant, levels)
