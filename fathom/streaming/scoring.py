"""Continuous scoring of observations that arrive as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import score_long


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def score_stream(
    model: PipelineModel, stream: DataFrame, key: str, inputs: Sequence[str], out: str, checkpoint: str,
    outcome: str = "temperature", continuous: bool = False,
) -> StreamingQuery:
    """Write (name, value) rows of every arriving observation; stateless, exactly once per file.

    By default everything that has arrived is scored and the query ends.
    """
    writer = (
        score_long(model, stream, key, inputs, outcome)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer if continuous else writer.trigger(availableNow=True)).start()
