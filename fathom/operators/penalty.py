"""Lasso paths of multinomial models: all penalties and all folds advance together.

A path is fitted for every fold's training rows and for all rows. Two kinds of passes read the data:

- one for moments: sums, products and class counts per fold, blocked in numpy. Training rows of a fold are
  all rows minus the fold, so no fold is read on its own;
- one per step for gradients. A task multiplies blocks of rows with the coefficients of all models that
  still move, leaves each row out of the models that hold it out, and returns one matrix.

Between passes the driver solves, for every model at once, a quadratic problem with the L1 term. The
quadratic comes from a bound on the curvature of the multinomial likelihood (one half of identity minus
1/classes, times the correlation of the inputs), so it needs no pass of its own, does not suffer from
correlated inputs, and no step can overshoot. Steps are extrapolated (accelerated) and start over where
that leads astray. The first problem is solved from the largest penalty down, each penalty starting from
the one before.

The driver holds inputs x inputs per fold and inputs x classes per model, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..session import materialise

BLOCK_CELLS = 1 << 21
#: A model stops when no slope is off by more than this: minus the penalty times the coefficient's sign, or
#: within the penalty at 0, for standardised inputs. All stop after ``STEPS`` passes.
TOLERANCE = 5e-5
STEPS = 120
SWEEPS = 100


def _matrix(batch: pa.RecordBatch, features: Sequence[str], centre: np.ndarray, scale: np.ndarray):
    """Inputs less ``centre`` over ``scale``, 0 where missing, and which are there."""
    raw = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
    there = ~np.isnan(raw)
    return np.where(there, (raw - centre) / scale, 0.0), there.astype(float)


def _summed(df: DataFrame, run, size: int) -> np.ndarray:
    """The sum of the arrays that ``run`` makes of each task's batches; Spark adds them up by place."""

    def parts(batches):
        total = run(batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], ["at", "v"])

    table = df.mapInArrow(parts, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[table["at"].to_numpy()] = table["v"].to_numpy()
    return out


@dataclass
class LassoPath:
    """Coefficients by model (folds, then all rows), penalty, class and input; inputs as they are."""

    features: list[str]
    labels: list
    penalties: list[float]
    folds: int
    means: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    steps: int

    def coefficients(self, spark) -> DataFrame:
        """fold (-1: all rows), penalty, class, term, estimate."""
        rows = []
        for m in range(self.folds + 1):
            fold = m if m < self.folds else -1
            for k, penalty in enumerate(self.penalties):
                for c, label in enumerate(self.labels):
                    rows.append((fold, penalty, label, "(Intercept)", float(self.intercepts[m, k, c])))
                    rows += [(fold, penalty, label, f, float(w)) for f, w in zip(self.features, self.weights[m, k, c])]
        return spark.createDataFrame(rows, "fold int, penalty double, class string, term string, estimate double")

    def predict(self, df: DataFrame, keep: Sequence[str], penalties: Sequence[float] | None = None, fold: str | None = None) -> DataFrame:
        """``keep``, ``penalty``, ``predict`` and ``p_<class>``, a row per row and penalty.

        With ``fold`` each row is predicted by the models that held it out, else by those of all rows.
        A missing input counts as its mean over the model's training rows.
        """
        chosen = [self.penalties.index(p) for p in (self.penalties if penalties is None else penalties)]
        weights, intercepts, means, labels = self.weights[:, chosen], self.intercepts[:, chosen], self.means, self.labels
        values, n, last = [self.penalties[k] for k in chosen], len(self.features), self.folds
        inputs = [quoted(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.features)]
        model = F.lit(last) if fold is None else quoted(fold).cast("int")
        rows = df.select(*inputs, model.alias("_model"), F.struct(*[quoted(c) for c in keep]).alias("_kept"))
        made = [T.StructField("penalty", T.DoubleType()), T.StructField("predict", T.StringType())]
        made += [T.StructField(f"p_{v}", T.DoubleType()) for v in labels]

        def run(batches):
            for batch in batches:
                raw, there = _matrix(batch, inputs_of, np.zeros(n), np.ones(n))
                which = batch.column(n).to_numpy(zero_copy_only=False).astype(int)
                x = np.where(there > 0, raw, means[which])
                margin = np.einsum("rj,rkcj->rkc", x, weights[which]) + intercepts[which]
                p = np.exp(margin - margin.max(axis=2, keepdims=True))
                p /= p.sum(axis=2, keepdims=True)
                best = p.argmax(axis=2)
                for k, penalty in enumerate(values):
                    guess = pa.array([labels[c] for c in best[:, k]], pa.string())
                    columns = [batch.column(n + 1), pa.array(np.full(len(x), penalty)), guess]
                    columns += [pa.array(np.ascontiguousarray(p[:, k, c])) for c in range(len(labels))]
                    yield pa.RecordBatch.from_arrays(columns, ["_kept", *[f.name for f in made]])

        inputs_of = range(n)
        found = rows.mapInArrow(run, T.StructType([rows.schema["_kept"], *made]))
        return found.select("_kept.*", *[quoted(f.name) for f in made])


def _moments(rows: DataFrame, n: int, classes: int, groups: int, centre: np.ndarray, scale: np.ndarray):
    """Per group: class counts, and the products there x there, x x there, x x x of the scaled inputs."""
    size = classes + 3 * n * n

    def run(batches):
        total = np.zeros((groups, size))
        for batch in batches:
            x, there = _matrix(batch, range(n), centre, scale)
            group = batch.column(n).to_numpy(zero_copy_only=False)
            label = batch.column(n + 1).to_numpy(zero_copy_only=False)
            for g in np.unique(group):
                own = group == g
                a, m = x[own], there[own]
                counts = np.bincount(label[own], minlength=classes)
                total[g] += np.concatenate((counts, (m.T @ m).ravel(), (a.T @ m).ravel(), (a.T @ a).ravel()))
        return total.ravel()

    found = _summed(rows, run, groups * size).reshape(groups, size)
    cut = lambda k: found[:, classes + k * n * n : classes + (k + 1) * n * n].reshape(groups, n, n)
    return found[:, :classes], cut(0), cut(1), cut(2)


def _gradients(rows: DataFrame, n: int, weights: np.ndarray, offsets: np.ndarray, centre: np.ndarray, scale: np.ndarray, held: np.ndarray):
    """For every model: sums of x, of there, and of 1, each times the error in every class.

    ``weights`` (models, classes, inputs) go with the scaled inputs, ``offsets`` (models, classes, inputs + 1)
    with the marks of inputs that are there and with 1; ``held`` is the group that a model leaves out.
    """
    models, classes, _ = weights.shape
    wide = weights.reshape(-1, n).T
    marks = offsets[:, :, :n].reshape(-1, n).T
    constant = offsets[:, :, n].ravel()
    step = max(1, BLOCK_CELLS // (models * classes))

    def run(batches):
        total = np.zeros((2 * n + 1, models * classes))
        for batch in batches:
            x, there = _matrix(batch, range(n), centre, scale)
            group = batch.column(n).to_numpy(zero_copy_only=False)
            label = batch.column(n + 1).to_numpy(zero_copy_only=False)
            for low in range(0, len(x), step):
                a, m, g, y = (v[low : low + step] for v in (x, there, group, label))
                margin = (a @ wide + m @ marks + constant).reshape(-1, models, classes)
                p = np.exp(margin - margin.max(axis=2, keepdims=True))
                p /= p.sum(axis=2, keepdims=True)
                p[np.arange(len(y)), :, y] -= 1.0
                p[g[:, None] == held[None, :]] = 0.0
                error = p.reshape(len(y), -1)
                total += np.concatenate((a.T @ error, m.T @ error, error.sum(axis=0)[None, :]))
        return total.ravel()

    found = _summed(rows, run, (2 * n + 1) * models * classes).reshape(2 * n + 1, models, classes)
    return np.moveaxis(found[:n], 0, 2), np.moveaxis(found[n : 2 * n], 0, 2), found[2 * n]


def _solved(beta, gradient, curvature, penalty, classes: int, sweeps: int = SWEEPS):
    """Minimise gradient * d + d' B d / 2 + penalty * |beta + d| over d for every model, one coordinate after another.

    B is one half of (identity minus 1/classes) in the classes times ``curvature`` in the inputs.
    """
    new, slope = beta.copy(), gradient.copy()  # slope: of the quadratic at new
    n = beta.shape[2]
    diagonal = 0.5 * (1 - 1 / classes) * np.maximum(curvature[:, np.arange(n), np.arange(n)], 1e-12)
    for _ in range(sweeps):
        most = 0.0
        for j in range(n):
            for c in range(classes):
                at = new[:, c, j] - slope[:, c, j] / diagonal[:, j]
                to = np.sign(at) * np.maximum(np.abs(at) - penalty / diagonal[:, j], 0.0)
                move = to - new[:, c, j]
                if not move.any():
                    continue
                most = max(most, float(np.abs(move).max()))
                new[:, c, j] = to
                turn = 0.5 * move[:, None] * curvature[:, j]
                slope -= (turn / classes)[:, None, :]
                slope[:, c] += turn
        if most < 1e-6:
            break
    return new


def lasso_path(
    df: DataFrame, features: Sequence[str], outcome: str, labels: Sequence, penalties: Sequence[float],
    fold: str | None = None, folds: int = 0, tolerance: float = TOLERANCE, steps: int = STEPS,
) -> LassoPath:
    """Multinomial models with an L1 penalty on coefficients of standardised inputs, for each penalty.

    ``fold`` numbers the rows from 0 to ``folds`` - 1; for each number a path is fitted on the other rows, and
    one on all rows. Rows without a class or of a class that is not in ``labels`` are left out. A missing
    input counts as the mean of its training rows. An input that never differs gets no weight.
    """
    features, labels = list(features), list(labels)
    n, classes = len(features), len(labels)
    grid = sorted((float(p) for p in penalties), reverse=True)
    names = F.array(*[F.lit(v) for v in labels])
    inputs = [quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    group = F.lit(0) if fold is None else quoted(fold).cast("int")
    rows = df.select(*inputs, group.alias("held"), (F.array_position(names, quoted(outcome)) - 1).cast("int").alias("label"))
    rows = materialise(rows.where("label >= 0"), "path")

    first = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(n)], *[F.stddev_samp(f"x{i}").alias(f"s{i}") for i in range(n)]).first()
    centre = np.array([first[f"m{i}"] or 0.0 for i in range(n)])
    scale = np.array([first[f"s{i}"] or 1.0 for i in range(n)])
    groups = max(1, folds)
    counts, there, sums, products = _moments(rows, n, classes, groups, centre, scale)

    def whole_minus(parts):
        total = parts.sum(axis=0, keepdims=True)
        return np.concatenate((total - parts, total)) if folds else total

    counts, there, sums, products = (whole_minus(v) for v in (counts, there, sums, products))
    size = np.maximum(counts.sum(axis=1), 1.0)
    known = np.maximum(np.einsum("fjj->fj", there), 1e-300)
    mean = np.einsum("fjj->fj", sums) / known
    # Centred products of inputs that are 0 at the mean where missing.
    centred = products - mean[:, None, :] * sums - mean[:, :, None] * np.swapaxes(sums, 1, 2) + mean[:, :, None] * mean[:, None, :] * there
    deviation = np.sqrt(np.maximum(np.einsum("fjj->fj", centred), 0.0) / np.maximum(size - 1, 1)[:, None])
    flat = deviation < 1e-9
    deviation[flat] = 1.0
    curvature = centred / (deviation[:, :, None] * deviation[:, None, :] * size[:, None, None])
    curvature[flat[:, :, None] | flat[:, None, :]] = 0.0

    sets, many = folds + 1, len(grid)
    model_set = np.repeat(np.arange(sets), many)
    penalty = np.tile(np.array(grid), sets)
    held = np.where(model_set < folds, model_set, -1) if folds else np.full(sets * many, -1)
    beta = np.zeros((sets * many, classes, n))
    shares = (counts + 1e-9) / (counts + 1e-9).sum(axis=1, keepdims=True)
    constant = np.log(shares)[model_set]
    before, constant_before = beta.copy(), constant.copy()
    at, constant_at = beta, constant
    last, constant_last = beta.copy(), constant.copy()  # where the slopes were taken last
    pace = np.ones(sets * many)
    moving = np.ones(sets * many, bool)
    done = 0
    while moving.any() and done < steps:
        done += 1
        on = np.flatnonzero(moving)
        own = model_set[on]
        b, d, mu, size_on = at[on], deviation[own], mean[own], size[own]
        weights = b / d[:, None, :]
        offsets = np.concatenate((-weights * mu[:, None, :], constant_at[on][:, :, None]), axis=2)
        gx, gm, g1 = _gradients(rows, n, weights, offsets, centre, scale, held[on])
        gradient = (gx - mu[:, None, :] * gm) / d[:, None, :] / size_on[:, None, None]
        gradient[np.broadcast_to(flat[own][:, None, :], gradient.shape)] = 0.0
        constant_before_step = constant_at[on]
        solve = _warm if done == 1 else _solved
        fresh = solve(b, gradient, curvature[own], penalty[on], classes, *([sets, many] if done == 1 else []))
        constant_new = constant_at[on] - 2.0 * (g1 / size_on[:, None] - (g1 / size_on[:, None]).mean(axis=1, keepdims=True))
        constant_new -= constant_new.mean(axis=1, keepdims=True)
        # Where the last move turns back against the step, extrapolation starts over.
        astray = ((b - fresh) * (fresh - before[on])).sum(axis=(1, 2)) + ((constant_at[on] - constant_new) * (constant_new - constant_before[on])).sum(axis=1) > 0
        bound = penalty[on][:, None, None]
        off = np.where(b != 0, np.abs(gradient + bound * np.sign(b)), np.abs(gradient) - bound)
        violation = np.maximum(off.max(axis=(1, 2), initial=0.0), np.abs(g1 / size_on[:, None]).max(axis=1))
        now = np.where(astray, 1.0, pace[on])
        later = (1 + np.sqrt(1 + 4 * now * now)) / 2
        ahead = np.where(astray, 0.0, (now - 1) / later)
        at, constant_at = at.copy(), constant_at.copy()
        at[on] = fresh + ahead[:, None, None] * (fresh - before[on])
        constant_at[on] = constant_new + ahead[:, None] * (constant_new - constant_before[on])
        pace[on] = later
        before[on], constant_before[on] = fresh, constant_new
        moving[on] = violation > tolerance
        last[on], constant_last[on] = b, constant_before_step
    raw = last / deviation[model_set][:, None, :] / scale
    shift = constant_last - (raw * (centre + mean[model_set] * scale)[:, None, :]).sum(axis=2)
    order = [grid.index(float(p)) for p in penalties]
    shaped = raw.reshape(sets, many, classes, n)[:, order]
    means = centre + mean * scale
    return LassoPath(features, labels, [float(p) for p in penalties], folds, means, shaped, shift.reshape(sets, many, classes)[:, order], done)


def _warm(beta, gradient, curvature, penalty, classes, sets, many):
    """The first problem by falling penalty, each solved from the one before."""
    shape = (sets, many, *beta.shape[1:])
    out = np.zeros(shape)
    gradients, curvatures, penalties = gradient.reshape(shape), curvature.reshape(sets, many, *curvature.shape[1:]), penalty.reshape(sets, many)
    last = np.zeros((sets, *beta.shape[1:]))
    for k in range(many):
        # The quadratic is about zero, so its slope at the last solution is known without the data.
        turn = 0.5 * np.einsum("fcj,fji->fci", last, curvatures[:, k])
        slope = gradients[:, k] + turn - turn.mean(axis=1, keepdims=True)
        last = _solved(last, slope, curvatures[:, k], penalties[:, k], classes)
        out[:, k] = last
    return out.reshape(beta.shape)


def lasso_violations(path: LassoPath, df: DataFrame, outcome: str) -> DataFrame:
    """penalty, class, term, violation: how far the models of all rows are from the conditions of a minimum.

    The mean slope of the likelihood by a coefficient of a standardised input is minus the penalty times the
    coefficient's sign, or no larger than the penalty if the coefficient is 0; that by an intercept is 0.
    Computed by Spark from the predictions alone, independently of the fit.
    """
    names = F.array(*[F.lit(v) for v in path.labels])
    known = df.where(F.array_contains(names, quoted(outcome)))
    inputs = [f"_v{i}" for i in range(len(path.features))]
    known = known.select(quoted(outcome).alias("_truth"), *[quoted(c).cast("double").alias(f"_r{i}") for i, c in enumerate(path.features)])
    means = [float(m) for m in path.means[-1]]
    filled = known.withColumns({v: F.coalesce(F.col(f"_r{i}"), F.lit(means[i])) - means[i] for i, v in enumerate(inputs)})
    spread = filled.agg(*[F.stddev_samp(v).alias(v) for v in inputs]).first()
    deviations = [spread[v] or 0.0 for v in inputs]
    raw = filled.withColumnsRenamed({f"_r{i}": c for i, c in enumerate(path.features)})
    predicted = path.predict(raw, ["_truth", *inputs])
    found = []
    for v in path.labels:
        error = quoted(f"p_{v}") - (F.col("_truth") == F.lit(v)).cast("double")
        terms = [("(Intercept)", F.avg(error))]
        terms += [(c, F.avg(error * F.col(i)) / d) for c, i, d in zip(path.features, inputs, deviations) if d > 1e-9]
        found += [F.struct(F.lit(v).alias("class"), F.lit(t).alias("term"), slope.alias("slope")) for t, slope in terms]
    slopes = predicted.groupBy("penalty").agg(F.array(*found).alias("s")).select("penalty", F.inline("s"))
    fitted = path.coefficients(df.sparkSession).where("fold = -1").drop("fold")
    bound = F.when(F.col("term") == "(Intercept)", F.abs("slope")).when(
        F.col("estimate") == 0, F.greatest(F.abs("slope") - F.col("penalty"), F.lit(0.0))
    )
    violation = bound.otherwise(F.abs(F.col("slope") + F.col("penalty") * F.signum("estimate")))
    return slopes.join(fitted, ["penalty", "class", "term"]).select("penalty", "class", "term", violation.alias("violation"))
