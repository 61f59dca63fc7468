"""The power of the Yeo-Johnson transform by a bracketed search for the root of the likelihood's slope.

The likelihood is concave in the power, so its slope changes sign once. A pass reads the wide rows and sums,
for a few powers of every column, the transformed values, their slopes and products; nothing is melted
or shuffled but these sums. The bracket of each column is cut by the sign of the slope and the next powers
are put around the root of the polynomial through the slopes inside it, so a few passes do.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted

# Bounds of the power: fixed values.
POWER_LOW, POWER_HIGH = -5.0, 5.0
POINTS = 5
PASSES = 12
TOLERANCE = 1e-7


def _branch(u: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """(e^(pu) - 1) / p and its slope in p, by their series where pu is small."""
    z = power * u
    small = np.abs(z) < 1e-3
    safe = np.where(small, 1.0, z)
    grown = np.exp(safe)
    value = u * np.where(small, 1 + z / 2 + z * z / 6, (grown - 1) / safe)
    slope = u * u * np.where(small, 0.5 + z / 3 + z * z / 8, (grown * (safe - 1) + 1) / (safe * safe))
    return value, slope


def transformed(x: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """The transform of ``x`` and its slope in the power."""
    value, slope = np.empty_like(x), np.empty_like(x)
    up = x >= 0
    value[up], slope[up] = _branch(np.log1p(x[up]), power)
    down, slope[~up] = _branch(np.log1p(-x[~up]), 2.0 - power)
    value[~up] = -down
    return value, slope


def _pass(rows: DataFrame, n: int, make, width: int) -> np.ndarray:
    """Sums over all rows, ``width`` for each column: tasks add up their own, Spark adds up the tasks'."""

    def run(batches):
        total = np.zeros((n, width))
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                for i in range(n):
                    x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                    x = x[~np.isnan(x)]
                    if len(x):
                        total[i] += make(i, x)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat, pa.float64())], ["at", "v"])

    found = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(n * width)
    out[found["at"].to_numpy()] = found["v"].to_numpy(zero_copy_only=False)
    return out.reshape(n, width)


def _varying(rows: DataFrame, n: int, least: int) -> np.ndarray:
    """Which columns have ``least`` different values; tasks return no more than that of each column."""

    def run(batches):
        seen = [np.empty(0)] * n
        for batch in batches:
            for i in range(n):
                if len(seen[i]) < least:
                    x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                    seen[i] = np.union1d(seen[i], x[~np.isnan(x)])[:least]
        counts = [len(s) for s in seen]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(n), counts), pa.int64()), pa.array(np.concatenate(seen), pa.float64())], ["at", "v"]
        )

    found = rows.mapInArrow(run, "at long, v double").distinct().groupBy("at").count().toArrow()
    out = np.zeros(n, int)
    out[found["at"].to_numpy()] = found["count"].to_numpy()
    return out >= least


def _next_points(points: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, float]:
    """The bracket of the root cut into new points, and the best guess at the root."""
    k = int(np.searchsorted(-np.sign(slopes), 0.0))  # slopes fall: first that is not positive
    if k == 0 or k == len(points):
        return points[:0], float(points[0 if k == 0 else -1])
    low, high = points[k - 1], points[k]
    a, b = slopes[k - 1], slopes[k]
    guess = low + (high - low) * a / (a - b) if np.isfinite(a - b) else (low + high) / 2
    near = np.isfinite(slopes)
    if near.sum() >= 3 and (np.diff(slopes[near]) < 0).all():
        # The power as a polynomial in the slope, at slope 0.
        y, p = slopes[near] / np.abs(slopes[near]).max(), points[near]
        inverse = sum(p[i] * np.prod([-y[j] / (y[i] - y[j]) for j in range(len(y)) if j != i]) for i in range(len(y)))
        if low < inverse < high:
            guess = inverse
    reach = (high - low) / 12
    inner = np.unique(np.clip([guess - reach, guess, guess + reach], low, high))
    return np.unique(np.concatenate(([low], inner, [high]))), float(guess)


def best_powers(df: DataFrame, columns: Sequence[str], least_values: int = 5) -> dict[str, float]:
    """The most likely power of each column in [-5, 5]; columns with fewer than ``least_values`` different values are left out."""
    columns = list(columns)
    rows = df.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    varying = _varying(rows, len(columns), max(2, least_values))
    chosen = np.flatnonzero(varying)
    if not len(chosen):
        return {}
    rows, n = rows.select(*[f"x{i}" for i in chosen]), len(chosen)
    sums = _pass(rows, n, lambda i, x: np.array([len(x), x.sum(), (np.sign(x) * np.log1p(np.abs(x))).sum()]), 3)
    count, mean, constant = sums[:, 0], sums[:, 1] / sums[:, 0], sums[:, 2]
    points = [np.linspace(POWER_LOW, POWER_HIGH, POINTS) for _ in range(n)]
    best = np.zeros(n)
    for _ in range(PASSES):
        open_ = [i for i in range(n) if len(points[i])]
        if not open_:
            break
        width = max(len(points[i]) for i in open_)
        middles = {i: [transformed(mean[i : i + 1], p) for p in points[i]] for i in open_}

        def make(i: int, x: np.ndarray) -> np.ndarray:
            out = np.zeros((width, 4))
            if i not in middles:
                return out.ravel()
            # Zeros stay zeros under every power, and in a column that is mostly zeros they are only counted.
            other = x[x != 0]
            zeros = len(x) - len(other)
            x, zeros = (other, zeros) if 2 * zeros > len(x) else (x, 0)
            for k, p in enumerate(points[i]):
                value, slope = transformed(x, p)
                a, b = (float(m[0]) for m in middles[i][k])
                value, slope = value - a, slope - b
                out[k] = value.sum(), (value * value).sum(), slope.sum(), (value * slope).sum()
                out[k] += zeros * np.array([-a, a * a, -b, a * b])
            return out.ravel()

        found = _pass(rows, n, make, 4 * width).reshape(n, width, 4)
        for i in open_:
            value, square, slope, product = (found[i, : len(points[i])] / count[i]).T
            with np.errstate(invalid="ignore", divide="ignore"):
                rise = -count[i] * (product - value * slope) / (square - value * value) + constant[i]
            # Beyond what doubles hold, the variance of a large power is what counts.
            rise = np.where(np.isfinite(rise), rise, np.where(points[i] > 1, -np.inf, np.inf))
            before = best[i]
            ends = points[i][0], points[i][-1]
            points[i], best[i] = _next_points(points[i], rise)
            if len(points[i]) and (abs(best[i] - before) < TOLERANCE and _ or ends[1] - ends[0] < TOLERANCE):
                points[i] = points[i][:0]
    return {columns[c]: float(b) for c, b in zip(chosen, best)}
