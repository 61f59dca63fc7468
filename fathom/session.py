"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .functions.columns import names_sql


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "fathom") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# Bytes of a task's shuffled rows and of its part of a file. Rows of repeated texts shrink to a twentieth when
# shuffled or stored, and a chain of joins holds them in several sorted buffers at once.
TASK_BYTES = 8 << 20
SPLIT_BYTES = 16 << 20
# Bytes of a batch that a Python task is handed. Such a batch is held several times over: as vectors that grow by
# doubling, as a stream, and in the Python worker.
ARROW_BYTES = 4 << 20
# Rows of the largest table for each partition that a shuffle starts with.
PARTITION_ROWS = 150_000


def bound_tasks(spark: SparkSession, rows: int) -> None:
    """Let the number of tasks follow the input, not their memory: small parts, and enough of them for ``rows`` rows.

    Spark joins shuffled parts up to the size that it is advised, which is for bytes as compressed. Settings that ask
    for smaller or more parts are left as they are.
    """
    for name, size in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        spark.conf.set(name, f"{min(_bytes(spark.conf.get(name)), size)}b")
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))
    spark.conf.set(name, str(max(int(spark.conf.get(name, None) or 0), parts)))


def bound_batches(spark: SparkSession) -> None:
    """Let batches for Python tasks be small in bytes, however long their rows; a smaller setting is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, f"{min(_bytes(spark.conf.get(name)), ARROW_BYTES)}b")


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session, whose executors all run on this machine, may fall back to a
    temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fathom-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``partition_by`` a filter on those columns reads only its files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    found = spark.read.schema(df.schema).parquet(path)
    return found.select(*names_sql(df.columns)) if partition_by else found
