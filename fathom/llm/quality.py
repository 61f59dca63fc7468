"""Text quality from supervised subword embeddings.

A text is the average of learned vectors, one for every word, every run of three and four characters
inside a word (with its borders) and every immediate repetition of a word, found by hash in a table of
fixed size. A softmax layer turns the average into class probabilities. Vectors and layer are trained by
stochastic gradient descent in numpy.

Training uses a bounded sample of labelled texts (``SAMPLE_ROWS`` with the smallest hashes of their
number): tasks reduce each to its hashes and counts, and only these come to the driver. As the layer is
linear, all that scoring needs is one number for each hash: the model sent to the tasks has a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns, column_of, list_array, pieces
from .store import fresh
from .words import PLAIN, find_words

SAMPLE_ROWS = 2000
HASH_BITS = 17
GRAMS = (3, 4)
DIMENSIONS = 8
EPOCHS = 5
RATE = 2.0
SEED = 17
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def feature_hashes(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All features of a piece, in runs by kind, and the row of each.

    Hashes of words and repetitions fill one half of the table, those of character runs the other.
    """
    half = np.uint64(64 - bits + 1)
    words = find_words(data, offsets, PLAIN)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(words.bounds))
    twice = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1])) + 1
    found = [(words.hashes >> half).astype(np.int32), np.zeros(len(twice), np.int32)]
    owners = [rows, rows[twice]]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) == 0:
        return np.concatenate(found), np.concatenate(owners)
    leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts = np.minimum(leads[offsets], len(codes))
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(starts))
    row = np.concatenate((row, np.full(len(codes) - len(row), len(offsets) - 2, np.int32)))
    space = (codes < 33) & _SPACES[np.minimum(codes, 255)]
    plain = np.where(space, np.uint32(32), codes)
    for n in GRAMS:
        if len(plain) < n:
            continue
        size = len(plain) - n + 1
        inside = ~space[1 : 1 + size]
        for k in range(2, n - 1):
            inside &= ~space[k : k + size]
        inside &= row[:size] == row[n - 1 :]
        at = np.flatnonzero(inside)
        total = np.full(size, n, np.uint32)
        for k in range(n):
            total = (total ^ plain[k : k + size]) * _MULTIPLIERS[k]
        total = total[at]
        total ^= total >> np.uint32(15)
        total *= np.uint32(2246822519)
        found.append((total >> np.uint32(32 - bits + 1)).astype(np.int32) + (1 << (bits - 1)))
        owners.append(row[at])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class QualityModel:
    """One number per hash and a constant: the difference of the two classes' outputs."""

    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of a piece; without features, that of the constant."""
        rows = len(offsets) - 1
        features, owners = feature_hashes(data, offsets, self.bits)
        total = np.bincount(owners, self.weights[features], minlength=rows)
        count = np.bincount(owners, minlength=rows)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))


def train(
    labels: np.ndarray, features: list[np.ndarray], counts: list[np.ndarray], bits: int, dimensions: int = DIMENSIONS,
    epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED,
) -> QualityModel:
    """Fit by stochastic gradient descent, one text at a time in a seeded order, with a falling rate.

    Two classes as in a softmax; the classes weigh alike. Without examples every score is 1/2.
    """
    draw = np.random.default_rng(seed)
    table = (draw.random((1 << bits, dimensions)) - 0.5) / dimensions
    layer = np.zeros((dimensions, 2))
    constant = np.zeros(2)
    shares = [c / c.sum() if len(c) else c for c in counts]
    sizes = np.maximum(np.bincount(labels, minlength=2), 1) if len(labels) else np.ones(2)
    weights = len(labels) / (2 * sizes)
    steps, done = max(1, epochs * len(labels)), 0
    for _ in range(epochs):
        for k in draw.permutation(len(labels)).tolist():
            step = rate * (1 - done / steps) * min(4.0, weights[labels[k]])
            done += 1
            share, ids = shares[k], features[k]
            hidden = share @ table[ids]
            out = hidden @ layer + constant
            p = np.exp(out - out.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = layer @ p
            layer -= step * np.outer(hidden, p)
            constant -= 0.01 * step * p
            table[ids] -= step * share[:, None] * back[None, :]
    difference = layer[:, 1] - layer[:, 0]
    return QualityModel((table @ difference).astype(np.float32), float(constant[1] - constant[0]), bits)


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learned from: one in five by the checksum of the number as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _with_features(docs: DataFrame, text: str, bits: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list:
        ids, counts, lengths = [], [], []
        for _, data, offsets in pieces(column_of(batch, text)):
            features, owners = feature_hashes(data, offsets, bits)
            keys, times = np.unique(owners.astype(np.int64) << bits | features, return_counts=True)
            ids.append((keys & ((1 << bits) - 1)).astype(np.int32))
            counts.append(times.astype(np.int32))
            lengths.append(np.bincount(keys >> bits, minlength=len(offsets) - 1))
        ids, counts, lengths = (np.concatenate(x) for x in (ids, counts, lengths))
        return [list_array(ids, lengths, pa.int32()), list_array(counts, lengths, pa.int32())]

    return add_columns(docs, "features array<int>, counts array<int>", make, without=(text,))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    bits: int = HASH_BITS,
    **options,
) -> QualityModel:
    """A model of ``label`` (0 or 1), learned from labelled rows that are not held out.

    Labels that are null or contradict each other for one number are left out; repeated ones count once.
    """
    sure = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    numbers = docs.select(F.col(doc_id).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    chosen = sure.join(numbers, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample_rows)
    picked = dict(map(tuple, chosen.toArrow().to_pandas().itertuples(index=False)))
    if not picked:
        return train(np.empty(0, int), [], [], bits, **options)
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, label int"
    few = F.broadcast(spark.createDataFrame([(i, int(y)) for i, y in picked.items()], schema))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(few, "doc_id")
    examples = _with_features(texts, "text", bits).toArrow()
    order = np.lexsort((np.array([len(x) for x in examples["features"]]), np.array(examples["doc_id"].to_pylist())))
    examples = examples.take(pa.array(order))
    arrays = [[x.values.to_numpy() for x in examples[c]] for c in ("features", "counts")]
    return train(examples["label"].to_numpy().astype(int), *arrays, bits, **options)


def with_score(docs: DataFrame, model: QualityModel, name: str = "score", text: str = "text", without: tuple[str, ...] = ()):
    """``docs`` with the score of each whole text, between 0 and 1; null is the empty text."""

    def make(batch: pa.RecordBatch) -> list:
        scores = [model.scores(data, offsets) for _, data, offsets in pieces(column_of(batch, text))]
        return [pa.array(np.concatenate(scores), pa.float64())]

    return add_columns(docs, f"{name} double", make, without)


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    name = fresh(docs, "quality_score")
    return with_score(docs, model, name, text).where(F.col(name) >= least).select(docs.columns)
