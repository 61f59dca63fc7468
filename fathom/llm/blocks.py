"""Pairs of different classes inside buckets, compared in blocks of bounded size.

A bucket holds rows that may be linked; linked rows found so far are one class. What is left are pairs of
different classes. Rows of a bucket are cut into blocks, by size first: sets whose sizes differ by more
than the similarity allows never meet. A class too large for one block has blocks of its own, which do not
meet each other, so a bucket that is nearly one class costs little more than its rows.

Most buckets hold few rows, and the same few rows share many of them: pairs of buckets up to ``SMALL_ROWS`` are
listed by a join and made distinct before anything else is known of them.

Blocks of the other buckets meet in tasks that see a set as parity bits only: whether each bin holds an odd number of its members.
A member that only one of two sets has turns one bit, so no more bits differ than members that a linked pair
leaves unmatched, and most pairs end there. There are a few bits per member, 1 KB at most. The rest come out once each, however many buckets they share, and are for the
caller to verify.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialise

from .batches import add_columns, column_of

#: Powers of two: the bits of the smallest and the largest sets.
FEWEST_BITS, MOST_BITS = 10, 13
BLOCK_ROWS = 1024
SMALL_ROWS = 8
_KINDS = {"bigint": pa.int64(), "binary": pa.binary()}


def parity_marks(members: np.ndarray) -> np.ndarray:
    """The parity of each bin of a set's 64-bit hashes, packed; bins are a power of two, twice as many as members or more."""
    bins = 1 << min(MOST_BITS, max(FEWEST_BITS, (2 * len(members) - 1).bit_length()))
    counts = np.bincount((members >> np.uint64(40)).astype(np.int64) % bins, minlength=bins)
    return np.packbits((counts & 1).astype(bool))


def _aligned(marks: list[bytes]) -> np.ndarray:
    """Parity marks by row, all as long as the shortest: the halves of a longer one are laid over each other."""
    least, found = min(map(len, marks)), []
    for mark in marks:
        bits = np.frombuffer(mark, np.uint8)
        while len(bits) > least:
            half = len(bits) // 2
            bits = bits[:half] ^ bits[half:]
        found.append(bits)
    return np.stack(found).view(np.uint64)


def _likely(rows: list[tuple], similarity: float, forest: bool) -> list[tuple]:
    """Pairs of one meeting (two blocks, side 0 and 1, or one block, side 2) that the bounds leave open.

    For a ``forest`` a pair counts as linked at once, so that later pairs of the same two classes are left out.
    """
    rows = sorted(rows, key=lambda r: r[0])
    side, key, root, n, kin, far, parity = zip(*rows)
    ids: dict = {}
    group = np.array([ids.setdefault(r, len(ids)) for r in root])
    if len(ids) < 2:
        return []
    n, kin, far = np.array(n), np.array(kin), np.array(far)
    marks = _aligned(parity)
    within = side[0] == 2
    ahead = len(rows) if within else side.count(0)
    out = []
    for i in range(ahead):
        j = np.arange(i + 1 if within else ahead, len(rows))
        j = j[(group[j] != group[i]) & ~(kin[j] & far[i]) & ~(far[j] & kin[i])]
        needed = similarity * (n[j] + n[i]) / (1 + similarity)
        keep = np.minimum(n[j], n[i]) >= needed - 1e-9
        j, needed = j[keep], needed[keep]
        most = n[j] + n[i] - 2 * needed + 1e-6
        # A bin whose parities differ holds a member that only one of the two has.
        j = j[np.bitwise_count(marks[j] ^ marks[i]).sum(axis=1) <= most]
        if forest and len(j):
            others, first = np.unique(group[j], return_index=True)
            j = j[first]
            group[np.isin(group, others)] = group[i]
        out += [(key[i], key[k]) for k in j.tolist()]
    return out


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their block (``level``, ``owner``, ``cell``), and how many cells each owner has."""
    classes = materialise(rows.groupBy("bucket", "level", "root").agg(F.count("*").alias("n")), "bucket-classes")
    own = F.when(F.col("n") > BLOCK_ROWS, F.hex("root")).otherwise("")
    cells = classes.groupBy("bucket", "level", own.alias("owner")).agg(F.ceil(F.sum("n") / BLOCK_ROWS).cast("int").alias("cells"))
    cells = materialise(cells, "cells")
    large = classes.where(F.col("n") > BLOCK_ROWS).select("bucket", "level", "root", F.hex("root").alias("owner"))
    placed = rows.join(large, ["bucket", "level", "root"], "left").withColumn("owner", F.coalesce("owner", F.lit("")))
    spread = F.xxhash64(F.when(F.col("owner") == "", F.hex("root")).otherwise(F.hex("key")))
    placed = placed.join(cells, ["bucket", "level", "owner"])
    return placed.withColumn("cell", F.pmod(spread, F.col("cells")).cast("int")).drop("cells"), cells


def _small_pairs(rows: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a``, ``b`` of small buckets that the bounds leave open."""
    rows = rows.select("bucket", "key", "root", "n_shingles", "kin", "far")
    one, two = (rows.select("bucket", *[F.col(c).alias(c + side) for c in rows.columns[1:]]) for side in ("_a", "_b"))
    total = F.col("n_shingles_a") + F.col("n_shingles_b")
    most = total - 2 * similarity * total / (1 + similarity) + 1e-6
    apart = "key_a < key_b AND root_a <> root_b AND NOT (kin_a AND far_b) AND NOT (far_a AND kin_b)"
    open_ = one.join(two, "bucket").where(apart).where(F.abs(F.col("n_shingles_a") - F.col("n_shingles_b")) <= most)
    open_ = open_.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), most.alias("most")).distinct()

    def make(batch: pa.RecordBatch) -> list:
        pairs = zip(*(column_of(batch, n).to_pylist() for n in ("one", "two", "most")))
        return [pa.array([int(np.bitwise_count(np.bitwise_xor(*_aligned([x, y]))).sum()) <= m for x, y, m in pairs], pa.bool_())]

    for name, key in (("one", "a"), ("two", "b")):
        open_ = open_.join(parities.select(F.col("key").alias(key), F.col("parity").alias(name)), key)
    return add_columns(open_, "near boolean", make, without=("one", "two", "most")).where("near").select("a", "b")


def likely_pairs(rows: DataFrame, parities: DataFrame, similarity: float, forest: bool = False) -> DataFrame:
    """Distinct pairs ``a``, ``b`` of different classes that share a bucket and may have ``similarity``.

    With ``forest`` only as many pairs of a meeting as would make its likely classes one: no more than its
    rows; of small buckets all pairs. A caller unites what these prove before it asks for all pairs, which are few by then.

    ``rows`` has ``bucket``, ``key``, ``root`` (the class), ``n_shingles`` and the marks ``kin`` and ``far``: no
    row that is kin is linked to one that is far in the same bucket. ``parities`` has the ``parity`` marks of every key.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("rows"))
    sized = materialise(rows.join(sizes, "bucket"), "sized")
    rows, small = sized.where(F.col("rows") > SMALL_ROWS).drop("rows"), sized.where(F.col("rows") <= SMALL_ROWS)
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / float(-np.log(similarity)) + 1e-9).cast("int")
    placed, cells = _blocks(rows.withColumn("level", level))
    one, two = (cells.select("bucket", "level", "owner", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
                .select("bucket", F.struct("level", "owner", "cell").alias(x)) for x in ("one", "two"))
    meet = one.join(two, "bucket").where(
        "one <= two AND two.level - one.level <= 1 AND (one.owner <> two.owner OR one.owner = '')"
    )
    meet = meet.withColumn("meeting", F.xxhash64("bucket", "one", "two"))
    sides = F.expr(
        "IF(one = two, array(struct(2 AS side, one AS block)), array(struct(0 AS side, one AS block), struct(1 AS side, two AS block)))"
    )
    sides = meet.select("bucket", "meeting", F.inline(sides))
    sides = sides.select("bucket", "meeting", "side", "block.level", "block.owner", "block.cell")
    names = ["side", "key", "root", "n_shingles", "kin", "far", "parity"]
    seats = placed.join(sides, ["bucket", "level", "owner", "cell"]).join(parities.select("key", "parity"), "key")
    seats = seats.select("bucket", "meeting", *names).repartition("bucket", "meeting").sortWithinPartitions("bucket", "meeting")
    kind = rows.schema["key"].dataType.simpleString()

    def pairs(held: list[tuple]) -> list[pa.RecordBatch]:
        found = _likely(held, similarity, forest) if len(held) > 1 else []
        return [pa.RecordBatch.from_arrays([pa.array(x, _KINDS[kind]) for x in zip(*found)], ["a", "b"])] if found else []

    def run(batches):
        held, now = [], None
        for batch in batches:
            marks = zip(column_of(batch, "bucket").to_pylist(), column_of(batch, "meeting").to_pylist())
            for mark, row in zip(marks, zip(*(column_of(batch, n).to_pylist() for n in names))):
                if mark != now:
                    yield from pairs(held)
                    held, now = [], mark
                held.append(row)
        yield from pairs(held)

    found = seats.mapInArrow(run, f"a {kind}, b {kind}").unionByName(_small_pairs(small, parities, similarity))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
