"""Lines that recur across documents, found with a fixed-depth tree of line templates.

A line is its words. Words with a digit, an @ or a :// are variable fields and become one wildcard.
The tree has a fixed depth: the number of words, then the first ``LEADING`` of them. A leaf that many
texts reach with different lines gets a template: at each place the word that most of its lines have,
or a wildcard if none has the majority. A line belongs to its leaf's template if at least
``similarity`` of its words equal the template's fixed words; otherwise it is a template of its own.

Templates that occur in ``min_texts`` different texts or more recur. All their lines are dropped but
those of one text, that with the smallest document number, so nothing is lost altogether. Exact copies
of a text count as one text and are treated alike: removing copies is another operator's work.
A line of ``long_words`` words or more does not repeat by chance: it recurs by itself from ``long_texts``
different texts on, equal but for variable fields, whatever its template.

Counts are combined before every shuffle, and a leaf is never collected: its template comes from
counts per place and word. Leaves worth a template are told to the tasks by a bitmap of fixed size;
a false hit there only means counting in vain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialise

from .batches import add_columns, column_of, list_array, pieces
from .store import fresh
from .words import PLAIN, _power_tables, find_words, mix

MIN_TEXTS = 5
LONG_WORDS = 20
LONG_TEXTS = 2
SIMILARITY = 0.8
LEADING = 3
_BITS = 26
_WILDCARD = np.uint64(0x2A2A2A2A2A2A2A2B)


def _variable_words(data: np.ndarray, words) -> np.ndarray:
    marks = (data >= 48) & (data <= 57) | (data == 64)
    if len(data) > 2:
        marks[:-2] |= (data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47)
    total = np.concatenate(([0], np.cumsum(marks)))
    return total[words.ends] > total[words.starts]


def parsed_lines(data: np.ndarray, offsets: np.ndarray, leading: int):
    """Of all lines of a piece: masked words, row, line number, first and end word, leaf, masked line."""
    words = find_words(data, offsets, PLAIN)
    masked = np.where(_variable_words(data, words), _WILDCARD, words.hashes)
    breaks = np.flatnonzero(data == 10) + 1
    begins = np.union1d(offsets[:-1], breaks[breaks < len(data)]) if len(data) else np.empty(0, np.int64)
    # A break at a row's end opens an empty line there, not one of the next row: both hold no word.
    rows = np.searchsorted(offsets, begins, side="right") - 1
    numbers = np.cumsum(np.concatenate(([0], data == 10)))
    numbers = numbers[begins] - numbers[offsets[rows]]
    low = np.searchsorted(words.starts, begins)
    high = np.append(low[1:], len(words.starts))
    kept = high > low
    rows, numbers, low, high = rows[kept], numbers[kept], low[kept], high[kept]
    size = (high - low).astype(np.uint64)
    power, inverse = _power_tables(len(masked) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(masked * power[: len(masked)])))
    line = mix((total[high] - total[low]) * inverse[low] + size)
    leaf = size
    for k in range(leading):
        at = np.minimum(low + k, high - 1)
        leaf = mix(leaf * np.uint64(0x9E3779B97F4A7C15) + np.where(low + k < high, masked[at], np.uint64(0)))
    return masked, rows, numbers, low, high, leaf, line


def _with_lines(texts: DataFrame, leading: int, long_words: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list:
        numbers, leaves, lines, long, counts = [], [], [], [], []
        for _, data, offsets in pieces(column_of(batch, "text")):
            _, rows, number, low, high, leaf, line = parsed_lines(data, offsets, leading)
            numbers.append(number.astype(np.int32))
            leaves.append(leaf.view(np.int64))
            lines.append(line.view(np.int64))
            long.append(high - low >= long_words)
            counts.append(np.bincount(rows, minlength=len(offsets) - 1))
        counts, numbers, leaves, lines, long = (np.concatenate(x) for x in (counts, numbers, leaves, lines, long))
        return [
            list_array(numbers, counts, pa.int32()),
            list_array(leaves, counts, pa.int64()),
            list_array(lines, counts, pa.int64()),
            list_array(long, counts, pa.bool_()),
        ]

    fields = "numbers array<int>, leaves array<long>, lines array<long>, long array<boolean>"
    return add_columns(texts, fields, make, without=("text",))


def _word_counts(texts: DataFrame, bitmap: np.ndarray, leading: int) -> DataFrame:
    """(leaf, line, place, word) of lines in marked leaves: one row per line and place."""

    def make(batch: pa.RecordBatch) -> list:
        leaves, lines, words, counts, sizes = [], [], [], [], []
        for _, data, offsets in pieces(column_of(batch, "text")):
            masked, rows, _, low, high, leaf, line = parsed_lines(data, offsets, leading)
            hit = _marked(bitmap, leaf)
            counts.append(np.bincount(rows[hit], minlength=len(offsets) - 1))
            size = (high - low)[hit]
            leaves.append(leaf[hit].view(np.int64))
            lines.append(line[hit].view(np.int64))
            sizes.append(size)
            places = np.repeat(low[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())
            words.append(masked[places].view(np.int64))
        counts, leaves, lines, words, sizes = (np.concatenate(x) for x in (counts, leaves, lines, words, sizes))
        rows = pa.StructArray.from_arrays(
            [pa.array(leaves), pa.array(lines), list_array(words, sizes, pa.int64())], ["leaf", "line", "words"]
        )
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), rows)]

    found = add_columns(texts, "found array<struct<leaf:long,line:long,words:array<long>>>", make, without=("text",))
    return found.select("key", F.inline("found"))


def _marked(bitmap: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    bit = leaf >> np.uint64(64 - _BITS)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(leaves: DataFrame) -> np.ndarray:
    """One bit for the leading bits of each leaf, combined on the cluster."""
    bit = F.shiftrightunsigned("leaf", 64 - _BITS)
    cells = leaves.groupBy(F.shiftrightunsigned(bit, 6).alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(leaf, {64 - _BITS}) & 63))")).alias("bits")
    )
    bitmap = np.zeros(1 << (_BITS - 6), np.int64)
    found = cells.toArrow()
    bitmap[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return bitmap.view(np.uint64)


def _recurring(lines: DataFrame, name: str, least: int, label: str) -> DataFrame:
    """Values of the column ``name`` that ``least`` texts hold, with the text that keeps its lines."""
    holders = lines.groupBy(name, "key").agg(F.min(F.struct("late", "doc_id")).alias("first"))
    found = holders.groupBy(name).agg(F.count("*").alias("texts"), F.min(F.struct("first", "key")).alias("keeper"))
    return materialise(found.where(f"texts >= {least}").select(name, F.col("keeper.key").alias("keeper")), label)


def recurring_lines(
    docs: DataFrame,
    name: str = "dropped",
    doc_id: str = "doc_id",
    text: str = "text",
    min_texts: int = MIN_TEXTS,
    similarity: float = SIMILARITY,
    leading: int = LEADING,
    long_words: int = LONG_WORDS,
    long_texts: int = LONG_TEXTS,
) -> DataFrame:
    """``docs`` with ``name``: the numbers (from 0) of the lines to drop, null if there are none.

    Lines end at ``\\n``; lines without a word are never dropped. Null and empty texts have no lines.
    Repeated rows are one text. A text without any ``doc_id`` is kept last. A column of ``docs`` called
    ``name`` is replaced; other columns stay. An empty table gives an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.unhex(F.md5(whole.cast("binary"))).alias("key"), F.col(doc_id).alias("doc_id"), whole.alias("text"))
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "numbers", "leaves", "lines", "long")
    texts = _with_lines(rows, leading, long_words).groupBy("key").agg(F.min(first).alias("first")).select("key", "first.*")
    lines = materialise(
        texts.where("size(numbers) > 0").select(
            "key", "late", "doc_id", F.inline(F.arrays_zip("numbers", "leaves", "lines", "long")).alias("number", "leaf", "line", "long")
        ),
        "lines",
    )

    # Leaves that different lines of enough texts reach; texts are counted once per leaf and line.
    per_line = lines.groupBy("leaf", "line").agg(F.count("*").alias("n")).groupBy("leaf")
    crowded = per_line.agg(F.sum("n").alias("n"), F.count("*").alias("different")).where(f"n >= {min_texts} AND different > 1")
    crowded = materialise(crowded.select("leaf"), "leaves")
    found = _word_counts(rows.select("key", "text"), _bitmap(crowded), leading)
    once = materialise(
        found.groupBy("leaf", "line").agg(F.min("words").alias("words")).join(crowded, "leaf", "left_semi"), "leaf-lines"
    )
    weights = lines.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    weighted = once.join(weights, ["leaf", "line"])
    places = weighted.select("leaf", "n", F.posexplode("words").alias("place", "word"))
    counts = places.groupBy("leaf", "place", "word").agg(F.sum("n").alias("n"))
    modes = counts.groupBy("leaf", "place").agg(F.max(F.struct("n", "word")).alias("top"), F.sum("n").alias("all"))
    fixed = modes.where("2 * top.n > all").select("leaf", "place", F.col("top.word").alias("word"))
    templates = materialise(fixed.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("place", "word"))).alias("fixed")), "templates")
    same = F.expr("size(filter(sequence(0, size(words) - 1), i -> fixed[i] = words[i]))")
    matched = materialise(
        once.join(templates, "leaf").where(same >= similarity * F.size("words") - 1e-9).select("leaf", "line"), "matched"
    )

    known = lines.join(matched.withColumn("template", F.col("leaf")), ["leaf", "line"], "left")
    named = materialise(
        known.select("key", "late", "doc_id", "number", F.coalesce(F.col("template"), F.col("line")).alias("template")), "named"
    )
    recurring = _recurring(named, "template", min_texts, "recurring")
    gone = named.join(recurring, "template").where("key <> keeper").select("key", "number")
    long = lines.where("long")
    again = _recurring(long, "line", min(min_texts, long_texts), "long-recurring")
    gone = gone.unionByName(long.join(again, "line").where("key <> keeper").select("key", "number"))
    lists = materialise(gone.groupBy("key").agg(F.sort_array(F.collect_set("number")).alias("numbers")), "drops")
    marked = fresh(docs, "text_key")
    out = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])
    out = out.withColumn(marked, F.unhex(F.md5(whole.cast("binary"))))
    lists = lists.select(F.col("key").alias(marked), F.col("numbers").alias(name))
    return out.join(lists, marked, "left").drop(marked)


def without_lines(docs: DataFrame, text: str, dropped: str) -> DataFrame:
    """``docs`` with the lines that a column lists gone from its texts; null stays null."""

    def make(batch: pa.RecordBatch) -> list:
        texts, lists = column_of(batch, text), column_of(batch, dropped)
        if lists.null_count == len(lists):
            return [texts.cast(pa.string())]
        kept = texts.to_pylist()
        for k in np.flatnonzero(lists.is_valid()).tolist():
            gone = set(lists[k].as_py())
            if kept[k] is not None:
                kept[k] = "\n".join(x for i, x in enumerate(kept[k].split("\n")) if i not in gone)
        return [pa.array(kept, pa.string())]

    return add_columns(docs, f"{text} string", make)


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with those lines gone from ``text``; see ``recurring_lines``."""
    dropped = fresh(docs, "dropped_lines")
    found = recurring_lines(docs, dropped, doc_id, text, **options)
    return without_lines(found, text, dropped).select(docs.columns)
