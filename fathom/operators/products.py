"""Sums of products for all pairs of columns, each over the rows that have both, by blocks of columns.

A task turns its rows into blocks of numbers and marks and multiplies every pair of column blocks, so one
pass gives the counts, sums, squares and products of all pairs, however many columns there are. Tiles travel
as arrays and are added up by their place; no task and not the driver holds all pairs of all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted

TILE = 64
#: A task passes its tiles on when they take more than so many doubles.
HELD_DOUBLES = 1 << 24
#: Per pair i < j: rows with both; sums of i and of j, of their squares, and of their product over these rows.
SUMS = ("n", "a", "b", "aa", "bb", "ab")


def _tile(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The six sums for all columns of one block against all of another; missing is NaN."""
    here, there = (~np.isnan(v) for v in (x, y))
    x, y = np.where(here, x, 0.0), np.where(there, y, 0.0)
    m, w = here.astype(float), there.astype(float)
    return np.stack([m.T @ w, x.T @ w, m.T @ y, (x * x).T @ w, m.T @ (y * y), x.T @ y])


def pair_products(df: DataFrame, columns: Sequence[str], group: str | None = None, tile: int = TILE) -> DataFrame:
    """(group,) i, j and ``SUMS`` for every pair of column positions i < j.

    Numbers are taken less the column's overall mean, which changes no correlation and keeps digits.
    """
    columns = list(columns)
    p = len(columns)
    inputs = [quoted(c).cast("double") for c in columns]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(inputs)]).first()
    centre = np.array([means[f"m{i}"] or 0.0 for i in range(p)])
    starts = list(range(0, p, tile))
    key = F.lit(None).cast("string") if group is None else quoted(group).cast("string")
    rows = df.select(key.alias("_group"), *[c.alias(f"x{i}") for i, c in enumerate(inputs)])
    schema = "_group string, r int, c int, sums binary"

    def emit(held: dict):
        if held:
            names = list(held)
            columns_ = [
                pa.array([g for g, _, _ in names], pa.string()), pa.array([r for _, r, _ in names], pa.int32()),
                pa.array([c for _, _, c in names], pa.int32()), pa.array([held[k].tobytes() for k in names], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns_, ["_group", "r", "c", "sums"])

    def multiply(batches):
        held, doubles = {}, 0
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(p)]) - centre
            names = batch.column(0).to_pylist()
            found: dict = {}
            of = np.array([found.setdefault(g, len(found)) for g in names])
            for g, k in found.items():
                own = x[of == k]
                for r in starts:
                    for c in starts[starts.index(r) :]:
                        made = _tile(own[:, r : r + tile], own[:, c : c + tile])
                        if (g, r, c) in held:
                            held[g, r, c] += made
                        else:
                            held[g, r, c] = made
                            doubles += made.size
            if doubles > HELD_DOUBLES:
                yield from emit(held)
                held, doubles = {}, 0
        yield from emit(held)

    def merge(batches):
        now, total = None, None
        for batch in batches:
            for g, r, c, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                part = np.frombuffer(raw).copy()
                if (g, r, c) == now:
                    total += part
                    continue
                if now is not None:
                    yield from pairs(now, total)
                now, total = (g, r, c), part
        if now is not None:
            yield from pairs(now, total)

    def pairs(place, total):
        g, r, c = place
        height, width = min(tile, p - r), min(tile, p - c)
        sums = total.reshape(6, height, width)
        i, j = (v.ravel() for v in np.meshgrid(np.arange(r, r + height), np.arange(c, c + width), indexing="ij"))
        keep = i < j
        arrays = [pa.array([g] * int(keep.sum()), pa.string()), *(pa.array(v[keep].astype(np.int32)) for v in (i, j))]
        arrays += [pa.array(s.ravel()[keep]) for s in sums]
        yield pa.RecordBatch.from_arrays(arrays, ["_group", "i", "j", *SUMS])

    tiles = rows.mapInArrow(multiply, schema).repartition("_group", "r", "c").sortWithinPartitions("_group", "r", "c")
    found = tiles.mapInArrow(merge, "_group string, i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    if group is None:
        return found.drop("_group")
    kind = df.schema[group].dataType
    return found.select(F.col("_group").cast(kind).alias(group), "i", "j", *SUMS)


def leading_values(correlations: DataFrame, p: int, k: int, extra: int = 5, rounds: int = 100, tolerance: float = 1e-10) -> list[float]:
    """The ``k`` largest eigenvalues of the matrix whose upper triangle is ``i``, ``j``, ``correlation``; 1 on the diagonal.

    Subspace iteration: a pass multiplies the stored pairs with a few vectors, which are all that travels. A
    missing correlation counts as 0.
    """
    width = min(p, k + extra)
    vectors = np.linalg.qr(np.random.default_rng(1).normal(size=(p, width)))[0]
    pairs = correlations.where("correlation IS NOT NULL").select("i", "j", F.col("correlation").cast("double"))
    before = np.full(min(k, p), np.inf)
    for _ in range(rounds):

        def multiply(batches, vectors=vectors):
            total = np.zeros((p, width))
            for batch in batches:
                i, j, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(3))
                np.add.at(total, i, c[:, None] * vectors[j])
                np.add.at(total, j, c[:, None] * vectors[i])
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["at", "v"])

        found = pairs.mapInArrow(multiply, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        made = vectors.copy().ravel()
        made[found["at"].to_numpy()] += found["v"].to_numpy()
        made = made.reshape(p, width)
        values = np.sort(np.linalg.eigvalsh(vectors.T @ made))[::-1][: min(k, p)]
        vectors = np.linalg.qr(made)[0]
        if np.abs(values - before).max() < tolerance * p:
            break
        before = values
    return [float(v) for v in values]
