"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source has a target number of tokens. Seats are blocks of ``block`` tokens: they go one by one to
the source with the highest quotient target / (2 * seats + 1), no source getting more than all its blocks
``repeats`` times. A source is cut into shards by a seeded hash of its documents, and its seats are
apportioned over its shards in the same way. Inside a shard the documents stand in seeded order and are
cut into blocks; all blocks are taken as often as the quota allows, and the rest of the quota goes to
blocks chosen by a seeded permutation. A document's share is what its blocks hold of it.

The driver sees one row per source and shard, of which there are ``SHARDS`` plus one per source at most,
whatever the size of the corpus; documents are only ever sorted inside a shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import materialise

from .batches import add_columns, column_of

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 8
SHARDS = 4096
REPEATS = 2
SEED = 20


def sainte_lague(weights: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats per party by highest quotients weight / (2 * seats + 1); ties go to the earlier party.

    No party gets more than its cap; if all are at theirs, seats are left over. Parties without
    weight get none. All but the last seats follow from the ideal shares, which are no less than a
    seat too high for any party; the remaining ones are dealt one by one.
    """
    weights = np.asarray(weights, float)
    caps = np.where(weights > 0, np.asarray(caps, np.int64), 0)
    seats = int(min(seats, caps.sum()))
    given = np.zeros(len(weights), np.int64)
    open_ = caps > 0
    while open_.any():
        ideal = weights * max(0, seats - given[~open_].sum()) / weights[open_].sum()
        full = open_ & (ideal >= caps)
        if not full.any():
            # The divisor method gives each open party its ideal share less one seat at least,
            # unless there are many parties: then start lower.
            low = np.floor(ideal - len(weights) / 2 * ideal / max(ideal[open_].sum(), 1) - 0.5)
            given[open_] = np.clip(low[open_], 0, caps[open_])
            break
        given[full] = caps[full]
        open_ &= ~full
    heap = [(-weights[k] / (2 * given[k] + 1), k) for k in np.flatnonzero(given < caps).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, k = heap[0]
        given[k] += 1
        if given[k] < caps[k]:
            heapq.heapreplace(heap, (-weights[k] / (2 * given[k] + 1), k))
        else:
            heapq.heappop(heap)
    return given


def filled_targets(weights: np.ndarray, sizes: np.ndarray, total: float, repeats: float) -> np.ndarray:
    """``total`` shared by weight; what a party has above ``repeats`` times its size is shared again."""
    caps = repeats * np.asarray(sizes, float)
    targets = np.zeros(len(caps))
    open_ = (caps > 0) & (np.asarray(weights) > 0)
    while open_.any():
        share = np.asarray(weights, float) * (total - targets[~open_].sum()) / np.sum(np.asarray(weights, float)[open_])
        above = open_ & (share > caps)
        if not above.any():
            targets[open_] = share[open_]
            break
        targets[above] = caps[above]
        open_ &= ~above
    return targets


def _permuted(blocks: np.ndarray, count: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Place of each block in a seeded order of the ``count`` blocks of its shard.

    An affine map with a factor prime to the count, which hits every place once.
    """
    count = count.astype(np.int64)
    factor = 1 + (seed.astype(np.uint64) >> np.uint64(33)).astype(np.int64) % np.maximum(count - 1, 1)
    while True:
        shared = np.gcd(factor, count) > 1
        if not shared.any():
            break
        factor[shared] = factor[shared] % count[shared] + 1
    shift = (seed.astype(np.uint64) & np.uint64(0x7FFFFFFF)).astype(np.int64) % np.maximum(count, 1)
    # Factors stay below 2^31 and so do block numbers, so products fit.
    return (blocks * factor + shift) % count


def taken_words(begin, size, shard_size, quota, seed, block: int) -> np.ndarray:
    """Words that a shard's quota of blocks takes from each document (arrays of equal length)."""
    begin, size, shard_size, quota = (np.asarray(x, np.int64) for x in (begin, size, shard_size, quota))
    count = -(-shard_size // block)
    whole, rest = np.divmod(quota, np.maximum(count, 1))
    taken = whole * size
    for a in range(0, len(size), 4096):
        part = slice(a, a + 4096)
        first = begin[part] // block
        last = np.where(size[part] > 0, (begin[part] + size[part] - 1) // block, first - 1)
        n = np.where(rest[part] > 0, last - first + 1, 0)
        if not n.sum():
            continue
        row = np.repeat(np.arange(len(n)), n)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
        chosen = _permuted(number, count[part][row], np.asarray(seed)[part][row]) < rest[part][row]
        low = np.maximum(number * block, begin[part][row])
        high = np.minimum((number + 1) * block, (begin[part] + size[part])[row])
        taken[part] += np.bincount(row, np.where(chosen, high - low, 0), minlength=len(n)).astype(np.int64)
    return taken


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = BLOCK,
    shards: int = SHARDS,
    repeats: int = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``.

    Sizes count runs of characters other than ASCII white space; null and empty texts have size 0 and
    nothing taken. Sources, by code point and null last, have ``weights`` in turn; their targets add up
    to ``share`` of all words, none above ``repeats`` times its source. Repeated rows are documents of
    their own; other columns are ignored; an empty table gives an empty table. Results depend on the
    rows and the seed alone.
    """
    rows = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r.source is None, str(r.source)))
    sizes = np.array([r["size"] for r in totals], float)
    given = np.array([weights[k % len(weights)] for k in range(len(totals))], float)
    targets = filled_targets(given, sizes, share * sizes.sum(), repeats)
    cuts = np.maximum(1, np.ceil(shards * sizes / max(sizes.sum(), 1)).astype(int))
    schema = f"source {rows.schema['source'].dataType.simpleString()}, number int, source_size long, target double, cuts int"
    listed = [(r.source, k, int(r["size"]), float(targets[k]), int(cuts[k])) for k, r in enumerate(totals)]
    sources = F.broadcast(docs.sparkSession.createDataFrame(listed, schema))
    placed = rows.join(sources.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = placed.withColumn("place", order).withColumn("shard", F.pmod(F.xxhash64("place"), "cuts").cast("int"))
    placed = materialise(placed, "placed")

    held = placed.groupBy("number", "shard").agg(F.sum("size").alias("shard_size")).orderBy("number", "shard").toArrow()
    number, shard, held_size = (held[c].to_numpy() for c in ("number", "shard", "shard_size"))
    blocks = -(-held_size // block)
    quota = np.zeros(len(blocks), np.int64)
    if len(totals):
        all_blocks = np.bincount(number, blocks, minlength=len(totals)).astype(np.int64)
        words_per_block = sizes / np.maximum(all_blocks, 1)
        wanted = targets / np.where(words_per_block > 0, words_per_block, 1)
        seats = sainte_lague(wanted, repeats * all_blocks, int(np.floor(wanted.sum() + 0.5)))
        for k in range(len(totals)):
            mine = number == k
            quota[mine] = sainte_lague(blocks[mine], repeats * blocks[mine], seats[k])
    quotas = docs.sparkSession.createDataFrame(
        list(zip(number.tolist(), shard.tolist(), held_size.tolist(), quota.tolist())),
        "number int, shard int, shard_size long, quota long",
    )
    before = Window.partitionBy("number", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        placed.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(F.broadcast(quotas), ["number", "shard"])
        .withColumn("turn", F.xxhash64(F.lit(seed + 1), "number", "shard"))
    )

    def make(batch: pa.RecordBatch) -> list:
        columns = [column_of(batch, n).to_numpy() for n in ("begin", "size", "shard_size", "quota", "turn")]
        return [pa.array(taken_words(*columns, block), pa.int64())]

    done = add_columns(laid, "taken long", make, without=("begin", "shard_size", "quota", "turn", "place", "cuts"))
    return done.select("doc_id", "source", "size", "source_size", "target", "taken")
