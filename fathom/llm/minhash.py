"""Near-duplicate texts by order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number so that equal
shingles of a text differ. One sketch of a text takes the ``per_sketch`` shingles with the smallest
hashes under one hash function and keeps them in text order; two texts share it if the same shingles
win and stand in the same order, which gets likelier with edit similarity. Texts that share a sketch
are candidates. A candidate pair is linked if an alignment inside a band keeps the order of enough
common shingles: common / (n1 + n2 - common) >= ``similarity``.

Exact copies are one text from the start. In every bucket (texts with one sketch in common) each text
is compared with a leader only, so pairs grow with the rows and not with the square of a bucket. Leader
is the text whose sketches are the most widely shared: in a family of copies, mostly their original.
One minus the similarity is a metric, so a text far from the leader (below 2 * ``similarity`` - 1) is
linked to none of the leader's copies; one nearer that is rejected is compared with further leaders.

Links become classes by connected components. Buckets whose texts are still of several classes are
then compared in full (``blocks``): every pair of different classes that the leader or counts of shingles
per bin do not rule out. A pair is aligned once at most, however many buckets its texts share. What a
leader settles saves work only; it decides no pair.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import materialise

from .batches import add_columns, column_of, list_array, pieces
from .blocks import likely_pairs, parity_marks
from .store import components, fresh
from .words import find_words, mix, occurrence_labels, row_shingles, sequence_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SKETCHES = 14
PER_SKETCH = 3
LEADERS = 4
_TURNS = np.random.default_rng(9).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """The shingles of one text with occurrence numbers: all differ."""
    if len(np.unique(shingles)) == len(shingles):
        return shingles
    labels = occurrence_labels(shingles).astype(np.uint64)
    return np.where(labels > 0, mix(shingles + labels * np.uint64(0x9E3779B97F4A7C15)), shingles)


def order_sketches(shingles: np.ndarray, sketches: int, per_sketch: int) -> np.ndarray:
    """The sketches of one text: hashes of its winning shingles in text order."""
    turned = (shingles[None, :] ^ _TURNS[:sketches, None]) * _TURNS[sketches : 2 * sketches, None]
    turned ^= turned >> np.uint64(29)
    if len(shingles) > per_sketch:
        at = np.argpartition(turned, per_sketch - 1, axis=1)[:, :per_sketch]
        at.sort(axis=1)
        turned = np.take_along_axis(turned, at, axis=1)
    total = np.arange(1, sketches + 1, dtype=np.uint64)
    for k in range(turned.shape[1]):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + turned[:, k])
    return total


def aligned(one: np.ndarray, two: np.ndarray, least: float) -> float:
    """Order-keeping similarity of two texts' labelled shingles, 0 if it is below ``least``.

    Enough common shingles leave at most ``slack`` unmatched ones, and a pair that stands in an
    alignment is that far off the diagonal at most: matches outside the band are left out. The
    longest chain of matches that rises in both texts is found by patience sorting.
    """
    n, m = len(one), len(two)
    if not n or not m:
        return 0.0
    needed = least * (n + m) / (1 + least)
    slack = n + m - 2 * needed
    if min(n, m) < needed - 1e-9:
        return 0.0
    _, left, right = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    inside = np.abs(left - right) <= slack + 1e-9
    left, right = left[inside], right[inside]
    if len(left) < needed - 1e-9:
        return 0.0
    chain = right[np.argsort(left)]
    if (np.diff(chain) > 0).all():
        common = len(chain)
    else:
        tops: list[int] = []
        for x in chain.tolist():
            k = bisect_left(tops, x)
            tops[k : k + 1] = [x]
        common = len(tops)
    score = common / (n + m - common)
    return score if score >= least - 1e-12 else 0.0


def _shingle_rows(column: pa.Array, length: int):
    for _, data, offsets in pieces(column):
        words = find_words(data, offsets)
        runs = sequence_hashes(words.hashes, length)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            yield labelled(runs[a : b - length + 1] if b - a >= length else row_shingles(words.hashes[a:b], length))


def sketched(texts: DataFrame, text: str, sketches: int, per_sketch: int, length: int) -> DataFrame:
    """``texts`` with ``n_shingles`` and ``sketch``, empty for a text without words."""

    def make(batch: pa.RecordBatch) -> list:
        counts, found = [], []
        for row in _shingle_rows(column_of(batch, text), length):
            counts.append(len(row))
            found.append(order_sketches(row, sketches, per_sketch) if len(row) else row)
        values = np.concatenate(found).astype(np.uint64).view(np.int64) if found else np.empty(0, np.int64)
        return [pa.array(counts, pa.int64()), list_array(values, np.array([len(f) for f in found]), pa.int64())]

    return add_columns(texts, "n_shingles long, sketch array<long>", make)


def _with_shingles(texts: DataFrame, length: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list:
        rows = [(r.tobytes(), parity_marks(r).tobytes()) for r in _shingle_rows(column_of(batch, "text"), length)]
        return [pa.array(column, pa.binary()) for column in zip(*rows)]

    return add_columns(texts, "shingles binary, parity binary", make).select("key", "shingles", "parity")


def _scored(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list:
        one, two = (column_of(batch, n) for n in ("one", "two"))
        scores = [
            aligned(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), least)
            for a, b in zip(one, two)
        ]
        return [pa.array(scores, pa.float64())]

    one = shingles.select("key", F.col("shingles").alias("one"))
    two = shingles.select(F.col("key").alias("leader"), F.col("shingles").alias("two"))
    joined = pairs.select("key", "leader").join(one, "key").join(two, "leader")
    return materialise(add_columns(joined, "score double", make, without=("one", "two")), "scores")


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))


def _shared(buckets: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one text, with ``weight``: how widely a text's buckets are shared."""
    sizes = materialise(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = materialise(buckets.join(sizes, "bucket"), "shared")
    weights = rows.groupBy("key").agg(F.sum("n").alias("weight"))
    return materialise(rows.drop("n").join(weights, "key"), "weighted")


def _leaders(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` heaviest texts of each bucket, numbered from 1; tasks keep no more before the shuffle."""
    order = Window.partitionBy("bucket").orderBy(F.col("weight").desc(), "key")
    first = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
    return materialise(first.select("bucket", "turn", F.col("key").alias("leader"), F.col("n_shingles").alias("n_leader")), "leaders")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of buckets that may hold a link between two classes; texts near the leader meet no text far from it."""
    state = rows.groupBy("bucket").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.count_if(~F.col("kin") & ~F.col("far")).alias("middle"),
        F.count_if("far").alias("distant"),
    )
    state = state.where("low <> high AND (middle > 0 OR distant > 1)").select("bucket", "middle")
    return materialise(rows.join(state, "bucket").where("NOT kin OR middle > 0").drop("middle"), "open")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    sketches: int = SKETCHES,
    per_sketch: int = PER_SKETCH,
    length: int = SHINGLE_WORDS,
    leaders: int = LEADERS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``key`` (MD5 of the text), ``class_id``, ``kept``.

    ``class_id`` is the smallest ``doc_id`` of the class; ``kept`` marks the rows with the smallest
    (``doc_id``, ``key``) of a class, more than one only if that row is repeated as a whole. Null text
    is empty text; all texts without a byte are one class, while texts of white space are linked to
    exact copies only. Texts under five words have one shingle of all their words. A null ``doc_id``
    stands after all others. Further columns are ignored; an empty table gives an empty table.
    """
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = sketched(rows, "text", sketches, per_sketch, length).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    marked = materialise(marked.select("doc_id", "key", "n_shingles", "sketch"), "sketches")
    last = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "n_shingles", "sketch")
    texts = materialise(
        marked.groupBy("key").agg(F.min(last).alias("first")).select("key", "first.doc_id", "first.n_shingles", "first.sketch"), "texts"
    )
    least = max(0.0, 2 * similarity - 1)
    near = F.least("n_shingles", "n_leader") >= least * F.greatest("n_shingles", "n_leader") - 1e-9
    members = _shared(texts.select("key", "n_shingles", F.explode("sketch").alias("bucket")))
    wanted = texts.join(members.select("key").distinct(), "key", "left_semi").select(
        F.col("key").alias("k"), F.col("doc_id").alias("d")
    )
    source = docs.select(key.alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = source.join(wanted, F.expr("key = k AND doc_id <=> d"), "left_semi").dropDuplicates(["key", "doc_id"])
    shingles = materialise(_with_shingles(chosen.select("key", "text"), length), "shingles")

    def against(rows: DataFrame, heads: DataFrame) -> DataFrame:
        return rows.join(heads.drop("turn"), "bucket").where("key <> leader")

    heads = _leaders(members, leaders)
    led = against(members, heads.where("turn = 1"))
    scores = _scored(led.where(near).select("key", "leader").distinct(), shingles, least)
    linked = F.col("score") >= similarity - 1e-12
    tested = led.join(scores, ["key", "leader"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    tested = materialise(tested.select("bucket", "key", "n_shingles", "score"), "tested")
    # Near enough to be linked to a copy of the leader: further leaders.
    further = against(tested.where(~linked & (F.col("score") > 0)), heads.where("turn > 1"))
    more = _edges(further.where(near)).distinct().join(_edges(scores), ["a", "b"], "left_anti")
    more = materialise(more.select(F.col("a").alias("key"), F.col("b").alias("leader")), "further")
    scores = scores.unionByName(_scored(more, shingles, least).select(scores.columns))
    edges = _edges(scores.where(linked))
    roots = components(edges)
    # The leader itself is done with: its bucket was scored against it.
    rows = tested.join(roots, tested["key"] == roots["node"], "left").select(
        "bucket", "key", "n_shingles", F.coalesce("root", "key").alias("root"), linked.alias("kin"), (F.col("score") == 0).alias("far")
    )
    rows = _open(rows)
    if not rows.isEmpty():
        pairs = likely_pairs(rows, shingles, similarity).join(_edges(scores).distinct(), ["a", "b"], "left_anti")
        pairs = materialise(pairs.select(F.col("b").alias("key"), F.col("a").alias("leader")), "pairs")
        found = _scored(pairs, shingles, similarity).where(linked)
        if not found.isEmpty():
            roots = components(edges.unionByName(_edges(found)))
    member = marked.select("doc_id", "key")
    whole = texts.join(roots, texts["key"] == roots["node"], "left").select(
        texts["key"].alias("key"), texts["doc_id"].alias("first_id"), F.coalesce("root", texts["key"]).alias("root")
    )
    whole = materialise(whole, "classes")
    head = whole.groupBy("root").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("late"), "first_id", "key")).alias("head")
    )
    known = materialise(
        whole.join(head, "root").select("key", F.col("head.first_id").alias("class_id"), F.col("head.key").alias("head_key")), "members"
    )
    return member.join(known, "key").select(
        "doc_id",
        "key",
        "class_id",
        F.expr("doc_id <=> class_id AND key = head_key").alias("kept"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` marks as kept; of rows equal in number and text the
    one whose other columns (but maps) come first in order."""
    chosen = near_duplicates(docs, doc_id, text, **options).where("kept")
    kept = materialise(chosen.select(F.col("key").alias("k"), F.col("doc_id").alias("d")).distinct(), "kept")
    key = fresh(docs, "text_key")
    marked = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    marked = marked.join(kept, (F.col(key) == F.col("k")) & F.col(doc_id).eqNullSafe(F.col("d")), "left_semi")
    others = [f.name for f in docs.schema if f.name not in (doc_id, text) and "map<" not in f.dataType.simpleString()]
    row, order = F.struct(*docs.columns), F.struct(F.lit(0), *others)
    return marked.groupBy(key, doc_id).agg(F.min_by(row, order).alias("row")).select("row.*")
