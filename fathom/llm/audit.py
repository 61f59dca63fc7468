"""What each filter of a chain adds, for every order of the filters.

A text is read once, byte by byte, by a transducer: two states (in a gap, in a word) and a table that
says for each state and byte which state follows and what the step means: a word begins or ends, a
capital, a code point, a symbol. As a byte alone fixes the next state, the states of all bytes of a
piece are one lookup. Words go into an open hash table as spans; a span that meets another with its
hash is compared with it byte for byte, so distinct words are counted exactly.

The five verdicts of a text are a number below 32. Counts per part and number are all that is shuffled;
the 120 orders are worked out from them, one row of a part at a time.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns, column_of, pieces
from .words import PLAIN, mix, span_hashes

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SYMBOLS = b"#$%&*|"

GAP, WORD = 0, 1
BEGINS, ENDS, CAPITAL, CODE_POINT, SYMBOL = 1, 2, 4, 8, 16
_COMPARED_BYTES = 1 << 20


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """The state after each byte, and what a step from each state by each byte means."""
    byte = np.arange(256)
    space = PLAIN[0]
    means = np.zeros((2, 256), np.uint8)
    means[:, (byte >= 65) & (byte <= 90)] |= CAPITAL
    means[:, byte & 0xC0 != 0x80] |= CODE_POINT
    means[:, list(SYMBOLS)] |= SYMBOL
    means[GAP, ~space] |= BEGINS
    means[WORD, space] |= ENDS
    return np.where(space, GAP, WORD).astype(np.uint8), means


NEXT, MEANS = _transducer()


def _distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which spans are the first of their bytes within their row (``owner``): an open hash table of spans."""
    n = len(starts)
    new = np.zeros(n, bool)
    slots = 1 << max(4, int(2 * n).bit_length())
    table = np.full(slots, -1, np.int64)
    at = (mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(slots - 1)).astype(np.int64)
    left = np.arange(n)
    while len(left):
        slot = at[left]
        free = table[slot] < 0
        table[slot[free][::-1]] = left[free][::-1]  # of several spans at one free slot the first stays
        held = table[slot]
        mine = held == left
        new[left[mine]] = True
        left, held = left[~mine], held[~mine]
        alike = (owner[left] == owner[held]) & (sizes[left] == sizes[held]) & (hashes[left] == hashes[held])
        alike[alike] = _same_bytes(data, starts[left[alike]], starts[held[alike]], sizes[left[alike]])
        left = left[~alike]
        at[left] = (at[left] + 1) & (slots - 1)
    return new


def _same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of equal sizes hold equal bytes, some spans at a time."""
    same = np.ones(len(one), bool)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(one):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + _COMPARED_BYTES, side="right")))
        size = sizes[low:high]
        first = ends[low:high] - size - before
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        unequal = data[np.repeat(one[low:high], size) + step] != data[np.repeat(two[low:high], size) + step]
        if unequal.any():
            same[low + np.repeat(np.arange(high - low), size)[unequal]] = False
        low = high
    return same


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each row of a piece."""
    state = np.empty(len(data), np.uint8)
    state[1:] = NEXT[data[:-1]]
    state[offsets[:-1][offsets[:-1] < len(data)]] = GAP
    means = MEANS[state, data]
    starts = np.flatnonzero(means & BEGINS)
    # A word ends where a step says so, or with its row.
    open_at = np.unique(offsets[1:][(offsets[1:] > 0)])
    open_at = open_at[NEXT[data[open_at - 1]] == WORD]
    ends = np.sort(np.concatenate((np.flatnonzero(means & ENDS), open_at)))
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    owner = np.repeat(np.arange(len(words)), words)
    new = _distinct(data, starts, ends - starts, span_hashes(data, PLAIN[1], starts, ends), owner)

    def count(meaning: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(means & meaning), offsets))

    return {
        "words": words,
        "distinct": np.bincount(owner[new], minlength=len(words)),
        "capitals": count(CAPITAL),
        "code_points": count(CODE_POINT),
        "symbols": count(SYMBOL),
    }


def failed_by_text(m: dict[str, np.ndarray]) -> np.ndarray:
    """The filters A to D that each row fails, one bit each, A the lowest."""
    failed = [
        m["words"] < LEAST_WORDS,
        100 * m["distinct"] < LEAST_DISTINCT * m["words"],
        100 * m["capitals"] > MOST_CAPITALS * m["code_points"],
        m["symbols"] > 0,
    ]
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``part``, ``failed`` (the failed filters A to E as bits 0 to 4).

    Null text is empty; an empty text fails A only, and E if a smaller number has one too. Texts are
    measured whole. A null ``doc_id`` stands behind all others; rows with equal numbers are no copies of
    each other. Null ``part`` is the empty string. An empty table gives an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(whole, 256))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        whole.alias("text"), digest.alias("digest"),
    )

    def make(batch: pa.RecordBatch) -> list:
        found = [failed_by_text(measure(data, offsets)) for _, data, offsets in pieces(column_of(batch, "text"))]
        return [pa.array(np.concatenate(found), pa.int32())]

    measured = add_columns(rows, "failed int", make, without=("text",))
    firsts = docs.groupBy(digest.alias("digest")).agg(F.min(doc_id).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("digest", "first")
    copy = F.expr("first IS NOT NULL AND (doc_id IS NULL OR doc_id > first)")
    return measured.join(firsts, "digest", "left").select(
        "doc_id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).cast("int").alias("failed")
    )


def _steps() -> tuple[list[str], list[int], dict[str, np.ndarray]]:
    """All (order, step) and, for each, which of the 32 verdicts it counts."""
    verdicts = np.arange(1 << len(FILTERS))
    orders, steps, counted = [], [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    failing = np.array([int(v).bit_count() for v in verdicts])
    rounds = len(list(permutations(FILTERS)))
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            fails, gone = verdicts & own > 0, verdicts & before > 0
            orders.append("".join(order))
            steps.append(step)
            counted["kept"].append(~gone & ~fails)
            counted["removed"].append(fails & ~gone)
            counted["redundant"].append(fails & gone)
            counted["unique_fails"].append(verdicts == own)
            # Each failed filter comes first in as many orders as any other.
            counted["shapley"].append(np.where(fails, rounds // np.maximum(failing, 1), 0))
            before |= own
    return orders, steps, {k: np.array(v, np.int64).T for k, v in counted.items()}


RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each filter does at each place of each order, by part: 600 rows for every part.

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``; a number that it repeats counts as good or toxic
    if any of its rows says so, and an unlabelled or null number is neither. Rows of ``docs`` count one by
    one, repeated ones too. An empty table gives an empty table; a part is never without rows.
    """
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    found = failures(docs, doc_id, text, part)
    marked = found.join(marks, F.col("doc_id") == F.col("label_id"), "left")
    counts = marked.groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("counts"))
    orders, steps, counted = _steps()

    def run(batches):
        for batch in batches:
            for name, rows in zip(column_of(batch, "part").to_pylist(), column_of(batch, "counts").to_pylist()):
                table = {k: np.zeros(1 << len(FILTERS), np.int64) for k in ("n", "good", "toxic")}
                for row in rows:
                    for k in table:
                        table[k][row["failed"]] += row[k]
                out = {k: table["n"] @ m for k, m in counted.items()}
                lost = [table[k] @ counted["removed"] for k in ("good", "toxic")]
                values = [out["kept"], out["removed"], out["redundant"], out["unique_fails"], *lost, out["shapley"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(steps), pa.string()), pa.array(orders, pa.string()), pa.array(steps, pa.int32())]
                    + [pa.array(v, pa.int64()) for v in values],
                    [c.split()[0] for c in RESULT.split(", ")],
                )

    return parts.mapInArrow(run, RESULT)
