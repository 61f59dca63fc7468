"""N-gram Jaccard join by prefixes of token combinations: exact links, returned as components.

A text is its set of word shingles, a token each. Texts with equal sets are one set from the start. Three
bounds on a pair with enough in common, all by counting tokens that a set may lack in its partner, lead to
the candidates:

- *Band.* Under one order of all tokens (their hashes) each set keeps its first ``errors + extension``
  tokens. Two linked sets share at least ``extension`` tokens of their bands. Only bands are shuffled.
- *Prefix.* In the band, tokens are put in order by how many bands hold them, rare ones first, and the
  shortest prefix is taken that keeps weight 1 when as many tokens are lost as a linked set may lack.
- *Signatures.* A token in at most ``RARE`` bands is a signature by itself and has weight 1. More frequent
  tokens are dealt by hash to classes, and only pairs of one class are signatures; c tokens of a class
  have weight c - 1. The prefix grows by a token for each class it touches, while texts that share one
  frequent shingle do not meet. Classes get more as sets get larger, so signatures stay in proportion; a
  set uses the classes of each size level that a partner may have.

Linked sets share a signature. The sets of a signature's bucket meet in blocks (``blocks``) that see bounds
only: first for just as many pairs as may make large families one, whose links become classes, then for all
pairs of classes that are still apart. Every candidate is verified on the whole sets, once. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialise

from .batches import add_columns, column_of, list_array, pieces
from .blocks import likely_pairs, parity_marks
from .store import components
from .suffixes import MAX_BITS, _bitmap, _marked
from .words import PLAIN, find_words, mix, row_shingles, sequence_hashes

PERCENT = 90
SHINGLE_WORDS = 3
EXTENSION = 48
RARE = 64
CLASS_TOKENS = 4

_CODES = np.arange(256)
#: Words between ASCII white space, A to Z as a to z.
LOWERED = (PLAIN[0], PLAIN[1][np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES)])


class Bounds:
    """What sets of a given size must share to reach ``percent`` per cent of their union."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("percent must be above 50 and at most 100")
        self.percent = percent

    def overlap(self, n: int) -> int:
        """Tokens that a set shares with any partner; so also the least size of a partner."""
        return -(-self.percent * n // 100)

    def errors(self, n: int) -> int:
        return n - self.overlap(n)

    def meets(self, n: int) -> bool:
        """Whether sets of this size may be linked to any but their equals."""
        return 100 * n // self.percent > n

    def extension(self, n: int) -> int:
        """Grows with ``n``, so of two linked sets the smaller one's holds."""
        return max(min(self.overlap(n), EXTENSION), self.errors(n) // 2)

    def band(self, n: int) -> int:
        return self.errors(n) + self.extension(n)

    def shared(self, n: int) -> int:
        """Tokens that the bands of linked sets have in common."""
        return self.extension(self.overlap(n))

    def levels(self, n: int) -> range:
        """The size levels that a set and a partner have in common: those of all sizes a partner may have."""
        return range(self.overlap(n).bit_length(), (100 * n // self.percent).bit_length() + 1)

    def classes(self, level: int) -> int:
        """Classes of frequent tokens at a level; 0 if sets of the level are too small to spare a token."""
        smallest = max(1, self.overlap(1 << (level - 1)))
        wanted = max(1, self.errors(1 << (level - 1)) // CLASS_TOKENS)
        return min(wanted, self.shared(smallest) - 1)


def signatures(tokens: np.ndarray, frequency: np.ndarray, n: int, bounds: Bounds) -> np.ndarray:
    """The signatures of one set: ``tokens`` are those of its band that other bands hold as well."""
    lost = bounds.band(n) - bounds.shared(n)
    alone = bounds.band(n) - len(tokens)
    if alone > lost:
        return np.empty(0, np.uint64)
    order = np.lexsort((tokens, frequency))
    tokens, frequent = tokens[order], frequency[order] > RARE
    found = []
    for level in bounds.levels(n):
        classes = bounds.classes(level)
        if not classes:
            found.append(mix(tokens[: lost - alone + 1]))
            continue
        kind = np.where(frequent, (tokens % np.uint64(classes)).astype(np.int64), -1)
        weight = np.ones(len(tokens), np.int64)
        weight[np.unique(kind, return_index=True)[1]] = 0
        weight[~frequent] = 1
        size = int(np.searchsorted(np.cumsum(weight), lost - alone + 1)) + 1
        kind, prefix = kind[:size], tokens[:size]
        found.append(mix(prefix[kind < 0]))
        for k in np.unique(kind[kind >= 0]).tolist():
            own = np.sort(prefix[kind == k])
            one, two = np.triu_indices(len(own), 1)
            found.append(mix(mix(own[one]) * np.uint64(0x9E3779B97F4A7C15) + own[two]))
    return np.unique(np.concatenate(found))


def _sets(column: pa.Array, length: int):
    """The sorted shingles of each row, without repetition."""
    for _, data, offsets in pieces(column):
        words = find_words(data, offsets, LOWERED)
        runs = sequence_hashes(words.hashes, length)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            yield np.unique(runs[a : b - length + 1] if b - a >= length else row_shingles(words.hashes[a:b], length))


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([*arrays, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return list_array(values, np.array([len(a) for a in arrays], np.int64), pa.int64())


def _described(rows: DataFrame, length: int, bounds: Bounds) -> DataFrame:
    """``doc_id``, the size and key of the row's set, and its band (empty if no other set can be linked)."""

    def make(batch: pa.RecordBatch) -> list:
        sizes, keys, bands = [], [], []
        for tokens in _sets(column_of(batch, "text"), length):
            n = len(tokens)
            sizes.append(n)
            keys.append(_key(tokens))
            bands.append(tokens[: bounds.band(n)] if bounds.meets(n) else tokens[:0])
        return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _longs(bands)]

    return add_columns(rows, "n_shingles long, key binary, band array<long>", make, without=("text",))


def _signed(shared: DataFrame, bounds: Bounds) -> DataFrame:
    """``node``, ``n_shingles``, and one row per signature (``bucket``)."""

    def make(batch: pa.RecordBatch) -> list:
        found, held = [], column_of(batch, "shared")
        members = held.flatten()
        frequency = members.field("frequency").to_numpy(zero_copy_only=False)
        tokens = members.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(pa.compute.list_value_length(held).to_numpy(zero_copy_only=False))
        for n, a, b in zip(column_of(batch, "n_shingles").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            found.append(signatures(tokens[a:b], frequency[a:b], n, bounds))
        return [_longs(found)]

    signed = add_columns(shared, "signature array<long>", make, without=("shared",))
    return signed.select("node", "n_shingles", F.explode("signature").alias("bucket"))


def _whole_sets(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``key`` (the node), ``members`` (its sorted shingles) and their ``parity``, for the wanted nodes.

    Texts stay where they are: a bitmap of the wanted numbers goes to all tasks, sets of other texts are not made,
    and only sets are shuffled. A number that is let through by chance has no wanted key.
    """
    wanted = materialise(wanted.select(F.col("key").alias("own"), "node", F.xxhash64("doc_id").alias("anchor")), "wanted")
    bits = min(MAX_BITS, max(16, ceil(log2(16 * max(wanted.count(), 1)))))
    bitmap = _bitmap(wanted, bits)

    def make(batch: pa.RecordBatch) -> list:
        hit = _marked(bitmap, column_of(batch, "anchor").to_numpy(zero_copy_only=False).view(np.uint64), bits)
        found = [[None] * batch.num_rows for _ in range(3)]
        for i, tokens in zip(np.flatnonzero(hit).tolist(), _sets(column_of(batch, "text").filter(pa.array(hit)), length)):
            for values, value in zip(found, (_key(tokens), tokens.tobytes(), parity_marks(tokens).tobytes())):
                values[i] = value
        return [pa.array(values, pa.binary()) for values in found]

    rows = docs.select(F.xxhash64("doc_id").alias("anchor"), "text")
    found = add_columns(rows, "own binary, members binary, parity binary", make, without=("anchor", "text"))
    # A set may stand on several rows.
    found = found.where("own IS NOT NULL").dropDuplicates(["own"]).join(wanted.select("own", "node"), "own")
    return materialise(found.select(F.col("node").alias("key"), "members", "parity"), "sets")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole sets are linked."""

    def make(batch: pa.RecordBatch) -> list:
        linked = []
        for x, y in zip(column_of(batch, "one"), column_of(batch, "two")):
            one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(100 * common >= percent * (len(one) + len(two) - common))
        return [pa.array(linked, pa.bool_())]

    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = sets.join(asked, "key", "left_semi")
    one = sets.select(F.col("key").alias("a"), F.col("members").alias("one"))
    two = sets.select(F.col("key").alias("b"), F.col("members").alias("two"))
    scored = add_columns(pairs.join(one, "a").join(two, "b"), "linked boolean", make, without=("one", "two"))
    return materialise(scored.where("linked").select("a", "b"), "links")


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root``, the class of their node."""
    known = roots.select(F.col("node").alias("k"), F.col("root").alias("r"))
    return rows.join(known, F.col("node") == F.col("k"), "left").withColumn("root", F.coalesce("r", "node")).drop("k", "r")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one class."""
    classes = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return materialise(rows.join(classes.select("bucket"), "bucket"), "mixed")


def _unmarked(rows: DataFrame) -> DataFrame:
    no = F.lit(False)
    return rows.select("bucket", F.col("node").alias("key"), "root", "n_shingles", no.alias("kin"), no.alias("far"))


def jaccard_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    length: int = SHINGLE_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Two rows are linked if their sets of ``length``-word shingles, of words between ASCII white space in lower
    case (A to Z only), have at least ``percent`` per cent of their union in common; ``component_id`` is the
    smallest ``doc_id`` that links lead to. A text of fewer words is one shingle; one without words (null,
    empty, white space) has no shingle, and its component is itself. Texts are read whole, whatever their
    length. Repeated rows are linked like any others. A null ``doc_id`` stands behind all others. Other
    columns are ignored; an empty table gives an empty table.
    """
    bounds = Bounds(percent)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    described = materialise(_described(rows, length, bounds), "described")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "n_shingles", "band")).alias("first")
    nodes = described.where("n_shingles > 0").groupBy("key").agg(first)
    nodes = nodes.select("key", "first.*").withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, "nodes")

    tokens = nodes.select("node", F.explode("band").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("frequency")).where("frequency > 1")
    shared = tokens.join(frequency, "token").groupBy("node").agg(F.collect_list(F.struct("frequency", "token")).alias("shared"))
    shared = shared.join(nodes.select("node", "n_shingles"), "node")
    signed = materialise(_signed(shared, bounds), "signatures")

    sizes = signed.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    rest = materialise(signed.join(sizes, "bucket").drop("rows").withColumn("root", F.col("node")), "shared")
    sets = _whole_sets(rows, nodes.join(rest.select("node").distinct(), "node", "left_semi"), length)
    tested, links, roots = [], [], rest.select("node", "root").limit(0)

    def settle(pairs: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
        """Verify the pairs that are new; the classes and, unless it is the last time, the open rows after that."""
        for known in tested:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        tested.append(materialise(pairs, "pairs"))
        links.append(_links(tested[-1], sets, percent))
        if links[-1].isEmpty():
            return roots, rest
        found = components(reduce(DataFrame.unionByName, links))
        return found, rest if last else _mixed(_placed(rest.drop("root"), found))

    # As many pairs as may make large families one; then every pair of classes that are still apart.
    roots, rest = settle(likely_pairs(_unmarked(rest), sets, percent / 100, forest=True))
    if not rest.isEmpty():
        roots, _ = settle(likely_pairs(_unmarked(rest), sets, percent / 100), last=True)

    placed = nodes.select("key", "doc_id", "late", "node").join(roots.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
    placed = placed.select("key", "late", F.col("doc_id").alias("first_id"), F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min(F.struct("late", "first_id")).alias("least"))
    known = placed.join(least, "root").select("key", F.col("least.first_id").alias("component_id"))
    final = described.select("doc_id", "n_shingles", "key").join(known, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return final.select("doc_id", "n_shingles", component.alias("component_id"))
