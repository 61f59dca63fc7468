"""Preprocessing steps: fitted once on training rows, applied to any rows.

Every step is an ML ``Estimator`` or ``Transformer``, so a recipe is a ``Pipeline`` and its fitted
form a ``PipelineModel`` that can be saved and loaded. Columns named in ``exclude`` (the outcome
and the row id) are carried along and never used as predictors.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable,
)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    long_cells, name_sql, names_sql, number_literal, numeric_columns, quoted, text_columns, text_literal, with_expressions,
)
from ..functions.numbers import few_avg
from ..session import materialise
from .neighbours import CELL_ROWS, Space, nearest_rows
from .ordering import hashed_rank
from .power import best_powers
from .profile import per_column

MAX_LEVELS = 1000
# Cells whose values a task counts at a time.
HELD_CELLS = 4_000_000


class _Settings(Params):
    """Settings and fitted state as one JSON-compatible parameter."""

    settings = Param(Params._dummy(), "settings", "settings or fitted state, JSON-compatible")

    def __init__(self, **settings: Any):
        super().__init__()
        self._set(settings=settings)

    def __getitem__(self, name: str) -> Any:
        return self.getOrDefault(self.settings).get(name)


class _Step(_Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    def predictors(self, df: DataFrame, kind: str) -> list[str]:
        """The named columns, or all predictors of a kind."""
        if self["columns"] is not None:
            return [c for c in self["columns"] if c in df.columns]
        pool = numeric_columns(df) if kind == "numeric" else text_columns(df)
        return [c for c in pool if c not in (self["exclude"] or ())]


class _Fitted(_Settings, Model, DefaultParamsReadable, DefaultParamsWritable):
    pass


class _PartsWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.save_parts(path)


class _PartsReader(DefaultParamsReader):
    def load(self, path: str):
        instance = super().load(path)
        instance.load_parts(path)
        return instance


class _FittedWithParts(_Settings, Model, MLWritable, MLReadable):
    """A fitted step that also keeps tables or models, saved beside its state."""

    def write(self):
        return _PartsWriter(self)

    @classmethod
    def read(cls):
        return _PartsReader(cls)


# --- columns -----------------------------------------------------------------------------------


class DropColumns(_Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self["columns"])


class KeepColumns(_Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Select the named columns, absent ones as missing numbers, and the excluded ones that are there."""

    def _transform(self, df: DataFrame) -> DataFrame:
        carried = self["exclude"] or ()
        names = dict.fromkeys([*carried, *self["columns"]])
        have = set(df.columns)
        return df.selectExpr(
            *[
                name_sql(c) if c in have else f"CAST(NULL AS DOUBLE) AS {name_sql(c)}"
                for c in names
                if c in have or c not in carried
            ]
        )


class ZeroVariance(_Step):
    """Finds predictors with at most one distinct known value; applied, it drops them."""

    def _fit(self, df: DataFrame) -> DropColumns:
        columns = [*self.predictors(df, "numeric"), *([] if self["columns"] else self.predictors(df, "text"))]
        if not columns:
            return DropColumns(columns=[])
        row = df.selectExpr(
            *[f"coalesce(min({c}) < max({c}), false) AS v{i}" for i, c in enumerate(names_sql(columns))]
        ).first()
        return DropColumns(columns=[c for i, c in enumerate(columns) if not row[f"v{i}"]])


def _number_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature and n of every different number: tasks count their own by sorting, nothing is melted but different values.

    Numbers are told apart by their bits, as by their text; the integer kinds count as they are.
    """
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    rows = df.select(*[quoted(c).cast("long" if c in whole else "double").alias(f"x{i}") for i, c in enumerate(columns)])

    def counted(held: list):
        places, values, sizes = [], [], []
        for i in range(len(columns)):
            x = pa.chunked_array([batch.column(i) for batch in held]).drop_null().to_numpy()
            if x.dtype.kind == "f":
                x = np.where(np.isnan(x), np.nan, x).view(np.int64)
            found, n = np.unique(x, return_counts=True)
            places.append(np.full(len(found), i, np.int32))
            values.append(found)
            sizes.append(n)
        arrays = [pa.array(np.concatenate(x)) for x in (places, values, sizes)]
        return pa.RecordBatch.from_arrays(arrays, ["at", "value", "n"])

    def run(batches):
        held, cells = [], 0
        for batch in batches:
            held.append(batch)
            cells += batch.num_rows * len(columns)
            if cells >= HELD_CELLS:
                yield counted(held)
                held, cells = [], 0
        if held:
            yield counted(held)

    found = rows.mapInArrow(run, "at int, value long, n long").groupBy("at", "value").agg(F.sum("n").alias("n"))
    return found.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("at")).alias("feature"), "n")


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n_rows, n_distinct, most and second_most: how often the commonest values occur."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType))}
    others = [c for c in columns if c not in numbers]
    parts = []
    if numbers & set(columns):
        parts.append(_number_counts(df, [c for c in columns if c in numbers]))
    if others:
        cells = long_cells(df, others, cast="string").where(F.col("value").isNotNull())
        parts.append(cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).select("feature", "n"))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Counted once, as the number of values for each frequency: a few rows per feature.
    sizes = materialise(counts.groupBy("feature", "n").agg(F.count(F.lit(1)).alias("values")), "value-counts")
    order = Window.partitionBy("feature").orderBy(F.col("n").desc())
    after = sizes.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("n").over(order))
    top = F.col("r") == 1
    return after.groupBy("feature").agg(
        F.sum(F.col("n") * F.col("values")).alias("n_rows"),
        F.sum("values").alias("n_distinct"),
        F.max(F.when(top, F.col("n"))).alias("most"),
        F.max(F.when(top, F.when(F.col("values") > 1, F.col("n")).otherwise(F.col("next")))).alias("second_most"),
    )


def near_zero_variance(df: DataFrame, columns: Sequence[str], ratio: float = 95 / 5, distinct_percent: float = 10.0) -> DataFrame:
    """The features dominated by one value: few distinct values, the commonest far ahead of the next; or without any."""
    table = value_frequencies(df, columns)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    share = F.col("n_distinct") * 100.0 / F.lit(df.count())
    lopsided = (F.col("most") / F.col("second_most") > ratio) & (share <= distinct_percent)
    few = F.coalesce(F.col("n_distinct"), F.lit(0)) <= 1
    return names.join(table, "feature", "left").where(few | lopsided).select("feature")


class NearZeroVariance(_Step):
    def _fit(self, df: DataFrame) -> DropColumns:
        columns = [*self.predictors(df, "numeric"), *([] if self["columns"] else self.predictors(df, "text"))]
        if not columns:
            return DropColumns(columns=[])
        found = near_zero_variance(df, columns, self["ratio"] or 95 / 5, self["distinct_percent"] or 10.0)
        return DropColumns(columns=sorted({r.feature for r in found.collect()}))


# --- missing values ----------------------------------------------------------------------------


class FillValues(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return with_expressions(
            df, {c: f"coalesce({name_sql(c)}, {text_literal(v)})" for c, v in self["values"].items() if c in have}
        )


class ModeImpute(_Step):
    """Missing categories become the commonest one, the first by name among equals."""

    def _fit(self, df: DataFrame) -> FillValues:
        columns = self.predictors(df, "text")
        if not columns:
            return FillValues(values={})
        return FillValues(values={r.feature: r.value for r in modes(df, columns).collect()})


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, n: the commonest value of each text column."""
    cells = long_cells(df, columns)
    counts = cells.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


class TargetImpute(_Step):
    """Missing outcomes become the prediction of 25 bagged trees grown on the rows that have one."""

    def _fit(self, df: DataFrame) -> "TargetImputeModel":
        target = self["target"]
        exclude = {target, *(self["exclude"] or ())}
        numeric = [c for c in numeric_columns(df) if c not in exclude]
        text = [c for c in text_columns(df) if c not in exclude]
        known = _with_doubles(df, numeric).where(quoted(target).isNotNull())
        stages: list = []
        inputs = []
        if numeric:
            stages.append(Imputer(inputCols=numeric, outputCols=[f"_in_{c}" for c in numeric], strategy="mean"))
            inputs += [f"_in_{c}" for c in numeric]
        levels = 0
        if text:
            stages.append(
                StringIndexer(
                    inputCols=text, outputCols=[f"_in_{c}" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc"
                )
            )
            inputs += [f"_in_{c}" for c in text]
            levels = max(df.agg(*[F.count_distinct(quoted(c)) for c in text]).first())
        stages.append(VectorAssembler(inputCols=inputs, outputCol="_in"))
        trees = dict(
            featuresCol="_in", numTrees=25, featureSubsetStrategy="all", maxBins=max(32, levels + 2), seed=self["seed"] or 1
        )
        if target in text_columns(df):
            label = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(known)
            known = label.transform(known)
            stages.append(RandomForestClassifier(labelCol="_label", predictionCol="_guess_code", **trees))
            stages.append(IndexToString(inputCol="_guess_code", outputCol="_guess", labels=label.labels))
        else:
            stages.append(RandomForestRegressor(labelCol=target, predictionCol="_guess", **trees))
        model = TargetImputeModel(target=target, numeric=numeric)
        model.trees = Pipeline(stages=stages).fit(known)
        return model


def _with_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return with_expressions(df, {c: f"CAST({name_sql(c)} AS DOUBLE)" for c in columns})


class TargetImputeModel(_FittedWithParts):
    trees: PipelineModel

    def save_parts(self, path: str) -> None:
        self.trees.save(f"{path}/trees")

    def load_parts(self, path: str) -> None:
        self.trees = PipelineModel.load(f"{path}/trees")

    def _transform(self, df: DataFrame) -> DataFrame:
        target = self["target"]
        if target not in df.columns:
            return df
        guessed = self.trees.transform(_with_doubles(df, self["numeric"]))
        return guessed.withColumn(target, F.coalesce(quoted(target), F.col("_guess"))).select(
            *names_sql(df.columns)
        )


class NeighbourImpute(_Step):
    """Missing numbers become the mean of the 5 nearest training rows that have them."""

    def _fit(self, df: DataFrame) -> "NeighbourImputeModel":
        exclude = set(self["exclude"] or ())
        numeric = [c for c in numeric_columns(df) if c not in exclude]
        text = [c for c in text_columns(df) if c not in exclude]
        targets = [c for c in (self["columns"] or numeric) if c in df.columns]
        space_columns = [c for c in numeric if c in (self["use"] or numeric)]
        bounds = df.selectExpr(
            *[f"CAST(max({c}) - min({c}) AS DOUBLE) AS w{i}" for i, c in enumerate(names_sql(space_columns))]
        ).first()
        model = NeighbourImputeModel(
            key=self["key"], targets=targets, numeric=space_columns,
            text=[c for c in text if c in (self["use"] or text)],
            ranges={c: bounds[f"w{i}"] or 0.0 for i, c in enumerate(space_columns)},
            neighbours=self["neighbours"] or 5, cell_rows=self["cell_rows"] or CELL_ROWS,
        )
        keep = dict.fromkeys([self["key"], *space_columns, *model["text"], *targets])
        model.donors = materialise(df.select(*names_sql(keep)), "donors")
        return model


class NeighbourImputeModel(_FittedWithParts):
    donors: DataFrame

    def save_parts(self, path: str) -> None:
        self.donors.write.mode("overwrite").parquet(f"{path}/donors")

    def load_parts(self, path: str) -> None:
        self.donors = SparkSession.active().read.parquet(f"{path}/donors")

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        key, targets = self["key"], [c for c in self["targets"] if c in columns]
        if not targets:
            return df
        lacking = " OR ".join(f"{c} IS NULL" for c in names_sql(targets))
        have = [c for c in (*self["numeric"], *self["text"]) if c in columns]
        # Rows are known by what they hold: keys may repeat, and equal rows are searched once.
        held = names_sql(dict.fromkeys([*have, *targets]))
        row = f"concat_ws('-', hex(xxhash64(1, {', '.join(held)})), hex(xxhash64(2, {', '.join(held)})))"
        asked = df.where(lacking).selectExpr(f"{row} AS {name_sql(key)}", *[h for h in held if h != name_sql(key)]).distinct()
        space = Space(
            [c for c in self["numeric"] if c in have], [c for c in self["text"] if c in have], self["ranges"]
        )
        near = nearest_rows(
            asked, self.donors, key, space, self["neighbours"], targets, cell_rows=self["cell_rows"], distinct_keys=True
        )
        # Searched once, however often the result is read; most targets are lacked by no row.
        means = materialise(near.groupBy(key, "target").agg(few_avg("value").alias("value")), "means")
        lacked = {r["target"] for r in means.select("target").distinct().collect()}
        doubles = {c: f"CAST({name_sql(c)} AS DOUBLE)" for c in targets}
        if not lacked:
            return with_expressions(df, doubles)
        found = [c for c in targets if c in lacked]
        values = (
            means.groupBy(key)
            .pivot("target", found)
            .agg(F.first("value"))
            .selectExpr(f"{name_sql(key)} AS _key", *[f"{name_sql(c)} AS {name_sql('_fill_' + c)}" for c in found])
        )
        values = materialise(values, "imputed")
        joined = df.join(values, F.expr(row) == F.col("_key"), "left")
        filled = {c: f"coalesce({doubles[c]}, {name_sql('_fill_' + c)})" for c in found}
        return joined.selectExpr(*[f"{(doubles | filled)[c]} AS {name_sql(c)}" if c in doubles else name_sql(c) for c in columns])


# --- numbers -----------------------------------------------------------------------------------


def yeo_johnson(x: str, power: str | float) -> str:
    """The signed power transform as SQL text; the logarithm where the power reaches its special values."""
    if not isinstance(power, str):
        p = number_literal(power)
        up = f"log1p({x})" if abs(power) < 1e-6 else f"(power({x} + 1, {p}) - 1) / {p}"
        q = number_literal(2.0 - power)
        down = f"-log1p(-{x})" if abs(2.0 - power) < 1e-6 else f"-(power(1 - {x}, {q}) - 1) / {q}"
        return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"
    return (
        f"CASE WHEN {x} >= 0 AND abs({power}) < 1e-6 THEN log1p({x}) "
        f"WHEN {x} >= 0 THEN (power({x} + 1, {power}) - 1) / {power} "
        f"WHEN abs(2 - {power}) < 1e-6 THEN -log1p(-{x}) "
        f"ELSE -(power(1 - {x}, 2 - {power}) - 1) / (2 - {power}) END"
    )


def power_likelihoods(counts: DataFrame, candidates: dict[str, list[float]], middles: dict[str, float]) -> DataFrame:
    """feature, power, likelihood: all candidate powers of all columns in one aggregate.

    ``counts`` holds feature, x and n. Transformed values are taken relative to that of the
    column's mean, so that their variance can be added up from weighted sums.
    """
    tries = len(next(iter(candidates.values())))
    rows = [(c, middles[c], *values) for c, values in candidates.items()]
    names = [f"p{i}" for i in range(tries)]
    grid = counts.sparkSession.createDataFrame(rows, "_feature string, middle double, " + ", ".join(f"{p} double" for p in names))
    # one row per column of the table
    joined = counts.join(F.broadcast(grid), F.col("feature") == F.col("_feature"))
    shifted = joined.selectExpr(
        "feature", "x", "n", *names,
        *[f"{yeo_johnson('x', p)} - {yeo_johnson('middle', p)} AS d{i}" for i, p in enumerate(names)],
    )
    sums = shifted.groupBy("feature").agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.expr("n * signum(x) * log1p(abs(x))")).alias("s"),
        *[F.expr(f"sum(n * d{i}) AS a{i}") for i in range(tries)],
        *[F.expr(f"sum(n * d{i} * d{i}) AS b{i}") for i in range(tries)],
        *[F.expr(f"first({p}) AS {p}") for p in names],
    )
    cells = ", ".join(f"struct(p{i} AS power, b{i} / n - a{i} * a{i} / n / n AS v)" for i in range(tries))
    return sums.selectExpr("feature", "n", "s", f"inline(array({cells}))").where("v > 0").selectExpr(
        "feature", "power", "-n / 2 * ln(v) + (power - 1) * s AS likelihood"
    )


class PowerTransform(_Step):
    def _fit(self, df: DataFrame) -> "PowerTransformModel":
        columns = self.predictors(df, "numeric")
        return PowerTransformModel(powers=best_powers(df, columns) if columns else {})


class PowerTransformModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        doubled = _with_doubles(df, [c for c in self["powers"] if c in set(df.columns)])
        have = set(df.columns)
        return with_expressions(
            doubled, {c: yeo_johnson(name_sql(c), p) for c, p in self["powers"].items() if c in have}
        )


class Normalise(_Step):
    """Subtract the mean and divide by the sample standard deviation."""

    def _fit(self, df: DataFrame) -> "NormaliseModel":
        columns = self.predictors(df, "numeric")
        if not columns:
            return NormaliseModel(scales={})
        rows = per_column(
            df, columns, {"m": lambda c: f"avg(CAST({c} AS DOUBLE))", "s": lambda c: f"stddev_samp(CAST({c} AS DOUBLE))"}
        ).collect()
        return NormaliseModel(scales={r.feature: [r.m, r.s] for r in rows})


class NormaliseModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return with_expressions(
            df,
            {
                c: f"try_divide(CAST({name_sql(c)} AS DOUBLE) - {number_literal(m)}, {number_literal(s)})"
                for c, (m, s) in self["scales"].items()
                if c in have and m is not None
            },
        )


# --- categories --------------------------------------------------------------------------------


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, n, share among the known values."""
    cells = long_cells(df, columns)
    counts = cells.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("feature").agg(F.sum("n").alias("_all"))
    return counts.join(sizes, "feature").select("feature", "value", "n", (F.col("n") / F.col("_all")).alias("share"))


def _levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    result = {}
    for c in columns:
        found = df.select(quoted(c).alias("v")).where(F.col("v").isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels; lump the rare ones first")
        result[c] = sorted(r.v for r in found)
    return result


class LumpRare(_Step):
    """Categories below a share of the training rows become ``other``."""

    def _fit(self, df: DataFrame) -> "LumpRareModel":
        columns = self.predictors(df, "text")
        threshold = self["threshold"] or 0.05
        kept: dict[str, list[str]] = {c: [] for c in columns}
        if columns:
            # No more than 1/threshold levels of a column can reach the threshold.
            for r in level_counts(df, columns).where(F.col("share") >= threshold).orderBy("feature", "value").collect():
                kept[r.feature].append(r.value)
        return LumpRareModel(kept=kept, other=self["other"] or "other")


class LumpRareModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: F.when(quoted(c).isNull() | quoted(c).isin(levels), quoted(c)).otherwise(F.lit(self["other"]))
                for c, levels in self["kept"].items()
                if c in df.columns
            }
        )


class NovelLevel(_Step):
    """Categories not seen in training become ``new``."""

    def _fit(self, df: DataFrame) -> "NovelLevelModel":
        columns = self.predictors(df, "text")
        model = NovelLevelModel(columns=columns, new=self["new"] or "new")
        cells = long_cells(df, columns)
        model.levels = materialise(cells.where(F.col("value").isNotNull()).distinct(), "levels")
        return model


class NovelLevelModel(_FittedWithParts):
    """Joins to the table of seen levels, which Spark broadcasts when it is small."""

    levels: DataFrame

    def save_parts(self, path: str) -> None:
        self.levels.write.mode("overwrite").parquet(f"{path}/levels")

    def load_parts(self, path: str) -> None:
        self.levels = SparkSession.active().read.parquet(f"{path}/levels")

    def _transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        for c in self["columns"]:
            if c not in order:
                continue
            seen = self.levels.where(F.col("feature") == c).select(F.col("value").alias("_seen"))
            df = df.join(seen, quoted(c) == F.col("_seen"), "left")
            value = F.when(quoted(c).isNull() | F.col("_seen").isNotNull(), quoted(c)).otherwise(F.lit(self["new"]))
            df = df.withColumn(c, value).drop("_seen")
        return df.select(*names_sql(order))


class UnknownLevel(_Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Missing categories become ``unknown``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = self["columns"] or [c for c in text_columns(df) if c not in (self["exclude"] or ())]
        return df.withColumns({c: F.coalesce(quoted(c), F.lit(self["unknown"] or "unknown")) for c in columns})


class CategoryCodes(_Step):
    """Text columns become 1-based codes of the sorted training levels; an unseen one is missing."""

    def _fit(self, df: DataFrame) -> "CategoryCodesModel":
        return CategoryCodesModel(levels=_levels(df, self.predictors(df, "text")))


class CategoryCodesModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), quoted(c)), F.lit(0))
                for c, levels in self["levels"].items()
                if c in df.columns
            }
        )


def dummy_name(column: str, level: str) -> str:
    return f"{column}_" + "".join(ch if ch.isalnum() else "_" for ch in level)


class Dummies(_Step):
    """0/1 columns ``column_level``: one per level, or without the first one."""

    def _fit(self, df: DataFrame) -> "DummiesModel":
        return DummiesModel(levels=_levels(df, self.predictors(df, "text")), one_hot=bool(self["one_hot"]))


class DummiesModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        have = df.columns
        made: dict[str, str] = {}
        for c, levels in self["levels"].items():
            if c not in have:
                continue
            for level in levels if self["one_hot"] else levels[1:]:
                name = dummy_name(c, level)
                while name in made or name in have:
                    name += "_"
                made[name] = f"CAST({name_sql(c)} = {text_literal(level)} AS DOUBLE)"
        rest = [c for c in have if c not in self["levels"]]
        return df.selectExpr(*names_sql(rest), *[f"{e} AS {name_sql(n)}" for n, e in made.items()])


# --- class balance -----------------------------------------------------------------------------


def smote(
    df: DataFrame, target: str, key: str, over_ratio: float = 1.0, neighbours: int = 5, seed: int = 1,
    columns: Sequence[str] | None = None, cell_rows: int = CELL_ROWS, group: str | None = None,
) -> DataFrame:
    """Add rows between minority rows and their neighbours until each class has ``over_ratio`` times the largest.

    Rows whose numbers are all missing have no neighbour; the others make up for them. With ``group`` every
    group is brought up on its own, all in one search; a key then names one row of a group.

    The key becomes text; new rows have the key of their first parent and a running number.
    Other columns than the numeric ones and the group are missing in new rows.
    """
    own = [] if group is None else [group]
    numeric = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in (target, key, *own)]
    sizes = {(r[group] if own else None, r[target]): r["count"] for r in df.groupBy(*own, target).count().limit(MAX_LEVELS + 1).collect()}
    if len(sizes) > MAX_LEVELS:
        raise ValueError(f"{target} has more than {MAX_LEVELS} classes")
    largest: dict = {}
    for (g, _), n in sizes.items():
        largest[g] = max(n, largest.get(g, 0))
    missing = {(g, c): int(largest[g] * over_ratio) - n for (g, c), n in sizes.items() if n < int(largest[g] * over_ratio)}
    alone = [c for c in missing if sizes[c] < 2]
    if alone:
        raise ValueError(f"classes with a single row have no neighbours: {alone if own else [c for _, c in alone]}")
    named = df.withColumn(key, quoted(key).cast("string"))
    if not missing:
        return named.withColumn("synthetic", F.lit(False))
    types = {c: df.schema[c].dataType.simpleString() for c in (*own, target)}
    schema = ", ".join([*([f"_group {types[group]}"] if own else []), f"_class {types[target]}"])
    lacking = F.broadcast(df.sparkSession.createDataFrame([c if own else c[1:] for c in missing], schema))  # a row per class
    same = quoted(target) == F.col("_class")
    for g in own:
        same = same & quoted(g).eqNullSafe(F.col("_group"))
    text = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    small = named.join(lacking, same).select(
        (F.concat(text(group), F.lit("\x1f"), quoted(key)) if own else quoted(key)).alias("_id"),
        (F.concat(text(group), F.lit("\x1f"), text(target)) if own else text(target)).alias("_part"),
        *[quoted(c) for c in (*own, target, key)], *[quoted(c).cast("double").alias(c) for c in numeric],
    )
    small = materialise(small, "minority")
    near = nearest_rows(small, small, "_id", Space(numeric, euclidean=True), neighbours, within="_part", cell_rows=cell_rows)
    # Rows without a neighbour, for want of numbers, make no copies: the others make theirs.
    near = materialise(near.select("_id", "donor", "rank"), "neighbours")
    found = near.groupBy("_id").agg(F.max("rank").alias("_found"))
    able = materialise(small.join(found, "_id"), "able")
    shares = {(r[group] if own else None, r[target]): r["count"] for r in able.groupBy(*own, target).count().collect()}
    without = [c for c in missing if c not in shares]
    if without:
        raise ValueError(f"classes in which no row has a neighbour: {without if own else [c for _, c in without]}")
    plan = df.sparkSession.createDataFrame(
        [(*(c if own else c[1:]), n // shares[c], n % shares[c]) for c, n in missing.items()], f"{schema}, _per_row long, _rest long"
    )
    ranked = hashed_rank(able, "_id", ["_part"], seed=seed, name="_rank")
    copies = ranked.join(F.broadcast(plan), same).withColumn(
        "_copies", (F.col("_per_row") + (F.col("_rank") <= F.col("_rest")).cast("long")).cast("int")
    )
    parents = copies.where(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("_id"), F.col("_copy"))
    parents = parents.withColumn("rank", (F.pmod(draw("neighbour"), F.col("_found")) + 1).cast("int"))
    pairs = parents.join(near, ["_id", "rank"])
    # A row's neighbour has that row as one at a known distance, so it is able as well.
    second = able.select(F.col("_id").alias("donor"), *[quoted(c).alias(f"_b_{c}") for c in numeric])
    share = F.pmod(draw("share"), F.lit(1000003)) / F.lit(1000003.0)
    made = pairs.join(second, "donor").select(
        F.concat(quoted(key), F.lit("+"), F.col("_copy").cast("string")).alias(key),
        *[quoted(c) for c in (*own, target)],
        *[(quoted(c) + share * (quoted(f"_b_{c}") - quoted(c))).cast("double").alias(c) for c in numeric],
        F.lit(True).alias("synthetic"),
    )
    real = _with_doubles(named, numeric).withColumn("synthetic", F.lit(False))
    return real.unionByName(made, allowMissingColumns=True)
