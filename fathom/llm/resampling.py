"""Importance resampling towards a target distribution, by hashed features and one noisy cutoff.

Corpus and target are counted into the same buckets. A bucket's gain is the smoothed logarithm of how
much likelier the target is to use it; a text's weight is the mean gain of its features, looked up in one
array. Noise that depends on the seed and the row's number alone turns the highest scores into a draw
without replacement by weight.

The cutoff of the draw is found without sorting the table: a quantile sketch brackets it, exact counts
outside the bracket prove that the cutoff lies inside or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import materialise

from .batches import add_columns, column_of, pieces
from .words import FOLDED, find_words

BUCKETS = 10_000
LONGEST_RUN = 1
SEED = 2024
LEAST_WORDS = 20
SHARE = 10
MARGIN = 0.002
_PLAIN_SPAN = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def span_checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data``, all spans one byte at a time; very long ones each by itself."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    long = int(np.searchsorted(-sizes, -_PLAIN_SPAN, side="left"))
    for k in range(long):
        out[order[k]] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]])
    starts, sizes = starts[long:], sizes[long:]
    value = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, side="left"))
        now = value[:n]
        value[:n] = _CRC[(now ^ data[starts[:n] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[order[long:]] = ~value
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every run of 1 to ``longest`` words of each row, the runs' rows, and the rows' word counts."""
    words = find_words(data, offsets, FOLDED)
    counts = np.diff(words.bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    sizes = words.ends - words.starts
    if longest == 1:
        return span_checksums(_LOWER[data], words.starts, sizes) % np.uint32(buckets), row, counts
    # Words side by side with one space between them, so that a run is a span.
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[np.repeat(starts, sizes) + step] = _LOWER[data[np.repeat(words.starts, sizes) + step]]
    found, owners = [], []
    for n in range(1, min(longest, len(starts)) + 1):
        first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        found.append(span_checksums(joined, starts[first], ends[first + n - 1] - 1 - starts[first]))
        owners.append(row[first])
    empty = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    return np.concatenate(found or empty[0]) % np.uint32(buckets), np.concatenate(owners or empty[1]), counts


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks add up; one array comes to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in pieces(column_of(batch, "t")):
                total += np.bincount(feature_buckets(data, offsets, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    parts = texts.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "bucket int, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to corpus, rounded down."""
    n = len(corpus)
    all_corpus, all_target = float(corpus.sum() + n), float(target.sum() + n)
    ratios = ((t + 1.0) * all_corpus / ((s + 1.0) * all_target) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, text: str = "text", longest: int = LONGEST_RUN, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``: the mean gain of a text's features, rounded down."""

    def make(batch: pa.RecordBatch) -> list:
        words, features, weights = [], [], []
        for _, data, offsets in pieces(column_of(batch, text)):
            found, owners, counts = feature_buckets(data, offsets, longest, len(gains))
            n = np.bincount(owners, minlength=len(counts))
            order = np.argsort(owners, kind="stable") if longest > 1 else slice(None)
            running = np.concatenate(([0], np.cumsum(gains[found[order]])))
            ends = np.cumsum(n)
            total = running[ends] - running[ends - n]
            words.append(counts)
            features.append(n)
            weights.append(np.floor_divide(total, np.maximum(n, 1)))
        return [pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in (words, features, weights)]

    return add_columns(docs, "n_words long, n_features long, weight long", make, without)


def seeded_noise(doc_id: str = "doc_id", seed: int = SEED):
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of seed and number; null is an empty number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def cutoff(scores: DataFrame, wanted: int, rows: int, score: str = "score", margin: float = MARGIN) -> int | None:
    """The score of the ``wanted``-th of the ``rows`` highest scores; null if none is wanted.

    A sketch gives a bracket around the wanted share. It holds the cutoff if fewer than ``wanted`` rows are
    above it and enough in it; otherwise it is widened fourfold. Scores are whole numbers, so sorting the
    bracket is counting its values: as many rows as it has different scores reach the driver.
    """
    if wanted <= 0:
        return None
    at = 1 - wanted / rows
    while True:
        sides = [max(0.0, at - margin), min(1.0, at + margin)]
        low, high = scores.agg(F.percentile_approx(score, sides, 10_000).alias("s")).first().s
        if sides[0] == 0.0:
            low = scores.agg(F.min(score).alias("s")).first().s
        inside = (F.col(score) >= low) & (F.col(score) <= high)
        above, held = scores.agg(F.count_if(F.col(score) > high).alias("above"), F.count_if(inside).alias("held")).first()
        if above < wanted <= above + held:
            break
        margin *= 4
    for value, n in scores.where(inside).groupBy(score).agg(F.count("*").alias("n")).orderBy(F.desc(score)).toLocalIterator():
        above += n
        if above >= wanted:
            return value


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST_RUN, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` (null if not drawn).

    Of the N rows with ``least_words`` words or more the ``share`` per cent with the highest scores are drawn,
    rounded down, and numbered from 1; ties go to the smaller number, null last, then to fewer features.
    Rows that agree in all of these are numbered one after another. Null text is empty and has weight 0; texts
    are read whole; repeated rows count one by one. An empty table gives an empty table, an empty target
    counts as one that uses no bucket. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weighed = with_weights(rows, gains, "text", longest, without=("text",))
    scored = materialise(weighed.withColumn("score", F.col("weight") + seeded_noise("doc_id", seed)), "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    n = fit.count()
    wanted = share * n // 100
    least = cutoff(fit, wanted, n)
    result = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select(*result, none)
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    # Noise spreads rows over scores: none has more than one row in 2,700, whatever the weights.
    sizes = scored.where(drawn).groupBy("score").agg(F.count("*").alias("n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("score").alias("s"), F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features"))
    ranked = scored.where(drawn).join(before, F.col("score") == F.col("s")).withColumn("rank", F.col("before") + turn)
    ranked = ranked.select(*result, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*result, none))
