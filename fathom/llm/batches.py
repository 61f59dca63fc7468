"""Arrow batches: new columns from a text column, and views of a text column as bytes.

Spark hands a Python task Arrow batches of many rows. ``add_columns`` asks for batches of few megabytes and works
on larger ones in parts, so that what a task holds does not follow the length of the texts. ``pieces`` cuts a batch into runs of whole
rows of about a megabyte, so that the arrays made from a piece stay small whatever a batch holds;
a single longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathom.session import bound_batches

PIECE_BYTES = 1 << 20
BATCH_BYTES = 1 << 22


def add_columns(
    df: DataFrame, fields: str, make: Callable[[pa.RecordBatch], list], without: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with the columns of ``fields`` (a schema in words), which ``make`` returns for a batch.

    Columns of ``df`` that have one of the new names, in any case, give way to the new ones; those
    in ``without`` are there for ``make`` but not returned.
    """
    bound_batches(df.sparkSession)
    new = T._parse_datatype_string(fields)
    taken = {f.name.lower() for f in new} | {n.lower() for n in without}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                columns = [column_of(batch, n) for n in names]
                yield pa.RecordBatch.from_arrays(columns + make(batch), names + new.fieldNames())

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``BATCH_BYTES``; none of an empty one."""
    step = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows: index of the first row, bytes, offsets."""
    data, offsets = text_bytes(column)
    rows, start = len(offsets) - 1, 0
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths that share one array of values."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
