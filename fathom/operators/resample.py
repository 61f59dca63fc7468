"""Splits and folds that depend on row keys alone, and what is computed over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_avg
from .ordering import HASH_MODULUS, hash_value, hashed_rank


def with_split(
    df: DataFrame, key: str, ratio: float = 0.85, seed: int = 1234, method: str = "xxhash64", name: str = "split"
) -> DataFrame:
    """Label rows ``train`` or ``test`` by a hash of the key: the same however the data is partitioned."""
    below = hash_value(key, seed, method) < int(ratio * HASH_MODULUS)
    return df.withColumn(name, F.when(below, "train").otherwise("test"))


def hash_sample(df: DataFrame, key: Column | str, ratio: float, seed: int = 7, method: str = "xxhash64") -> DataFrame:
    """The rows whose key has a small hash: about ``ratio`` of them, the same however the data is partitioned."""
    return df.where(hash_value(key, seed, method) < int(ratio * HASH_MODULUS))


def random_split(
    df: DataFrame, key: str, ratio: float = 0.85, seed: int = 1234, method: str = "xxhash64"
) -> tuple[DataFrame, DataFrame]:
    labelled = with_split(df, key, ratio, seed, method, "_split")
    return (
        labelled.where(F.col("_split") == "train").drop("_split"),
        labelled.where(F.col("_split") == "test").drop("_split"),
    )


def with_stratified_split(
    df: DataFrame, strata: str, key: str, ratio: float = 0.75, seed: int = 1234, method: str = "xxhash64",
    name: str = "split",
) -> DataFrame:
    """Label rows so that every stratum is divided in the same ratio."""
    ranked = hashed_rank(df, key, [strata], seed, method, "_rank", total="_size")
    inside = F.col("_rank") <= F.floor(F.col("_size") * F.lit(ratio) + 0.5)
    return ranked.withColumn(name, F.when(inside, "train").otherwise("test")).drop("_rank", "_size")


def with_folds(
    df: DataFrame, key: str, v: int = 10, strata: str | None = None, seed: int = 1234, method: str = "xxhash64",
    name: str = "fold",
) -> DataFrame:
    """Deal rows out to v folds in hash order, within each stratum if one is given."""
    ranked = hashed_rank(df, key, [strata] if strata else [], seed, method, "_rank")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % v).cast("int")).drop("_rank")


def with_spatial_folds(
    df: DataFrame, key: str, coordinates: Sequence[str] = ("lon", "lat"), v: int = 10, seed: int = 123,
    name: str = "fold",
) -> DataFrame:
    """One fold per k-means cluster of the coordinates; rows without a position are dealt out by hash."""
    located = F.lit(True)
    for c in coordinates:
        located = located & F.col(c).isNotNull()
    assembler = VectorAssembler(inputCols=list(coordinates), outputCol="_place")
    clusters = KMeans(k=v, seed=seed, featuresCol="_place", predictionCol=name)
    placed = assembler.transform(df.where(located))
    near = clusters.fit(placed).transform(placed).drop("_place")
    rest = df.where(~located).withColumn(name, (hash_value(key, seed) % v).cast("int"))
    return near.unionByName(rest)


def labelled_splits(df: DataFrame, v: int, fold: str = "fold") -> DataFrame:
    """Every row once per fold, labelled by its part in it."""
    return df.withColumn("split_id", F.explode(F.array(*[F.lit(i) for i in range(v)]))).withColumn(
        "part", F.when(F.col(fold) == F.col("split_id"), "Assessment").otherwise("Analysis")
    )


def penalty_grid(low: float = -5, high: float = 0, levels: int = 20) -> list[float]:
    """Evenly spaced on the log10 scale."""
    return [10 ** (low + (high - low) * i / (levels - 1)) for i in range(levels)]


def summarise_metrics(by_fold: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """mean, standard error and number of folds of each metric."""
    return by_fold.groupBy(*groups, "metric").agg(
        exact_avg("value", 10).alias("mean"),
        (F.stddev_samp("value") / F.sqrt(F.count("value").cast("double"))).alias("std_err"),
        F.count("value").alias("n"),
    )


def select_best(summary: DataFrame, metric: str, maximise: bool = True) -> DataFrame:
    """The setting with the best mean; among equals the largest penalty."""
    order = F.col("mean").desc_nulls_last() if maximise else F.col("mean").asc_nulls_last()
    return summary.where(F.col("metric") == metric).orderBy(order, F.col("penalty").desc()).limit(1)


def select_by_one_std_err(summary: DataFrame, metric: str, maximise: bool = True) -> DataFrame:
    """The largest penalty whose mean is within one standard error of the best."""
    best = select_best(summary, metric, maximise).first()
    if best is None:
        raise ValueError(f"no results for {metric}")
    reach = best["std_err"] or 0.0
    near = F.col("mean") >= best["mean"] - reach if maximise else F.col("mean") <= best["mean"] + reach
    return summary.where((F.col("metric") == metric) & near).orderBy(F.col("penalty").desc()).limit(1)
