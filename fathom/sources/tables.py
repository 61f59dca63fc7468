"""Reading and writing tables: Parquet, JDBC, CSV, the session catalogue, rows from scalars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 200,
    properties: Mapping[str, str] | None = None,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """A relational table, read by several tasks: one for each of the ``predicates``, which must share out
    the rows, or one for each range of ``partition_column``."""
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(properties or {}))
    if partition_column is None or bounds is None:
        raise ValueError("a table of any size is read in parts: give predicates, or a column and its bounds")
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
        properties=dict(properties or {}),
    )


def load_catalogue(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Every table and view of the session catalogue, by name."""
    listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return {
        t.name: spark.table(t.name if t.isTemporary or not database else f"{database}.{t.name}")
        for t in listed
    }


def write_store(
    df: DataFrame, path: str, partition_by: Sequence[str] = ()
) -> None:
    """Replace a stored table. Dates stay dates; ``partition_by`` lets later filters skip files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_table(df: DataFrame, name: str, bucket: tuple[int, str] | None = None) -> None:
    """Replace a catalogue table; bucketing by the join key saves later shuffles."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket:
        writer = writer.bucketBy(bucket[0], bucket[1]).sortBy(bucket[1])
    writer.saveAsTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    """Files with a header, compressed: as text a row takes ten times the bytes."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def rows_from_scalars(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    """A small table built from typed values."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
