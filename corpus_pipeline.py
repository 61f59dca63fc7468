"""From raw documents to a weighted training mix, in five stages.

Each stage takes all documents that its predecessor kept; between stages they are a table in the shared
folder. All but the last return the columns of ``documents``. Null texts count as empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontamination, lines, minhash, mixing, quality
from fathom.llm.store import fresh
from fathom.session import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that recur elsewhere; one with no other words goes as a whole."""
    before = fresh(docs, "had_words")
    marked = docs.withColumn(before, F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False)))
    left = lines.drop_recurring_lines(marked)
    left = left.where(~F.col(before) | F.col("text").rlike(mixing.WORD)).drop(before)
    changed = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(changed).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The first document of each class of near copies; of rows repeated as a whole, one."""
    return minhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    name = fresh(docs, "leaks")
    found = decontamination.find_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), name)
    return found.where(F.size(name) == 0).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """How many words the mix takes from each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source mix", mix_sources),
]

#: No stage but the last can be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
