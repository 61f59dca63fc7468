"""Benchmark items in training text: BM25 over an inverted index of the items, block-max WAND, overlap.

The items are the small side: they are indexed, and every passage of every text is a query. A score is
BM25 of the passage's distinct words for an item, divided by the score of the item's own words, so that
one threshold holds for all items. WAND walks the posting lists in item order and skips items, and with
block maxima whole blocks of postings, that cannot reach the threshold; what it returns is exactly the
items at or above it. Of these the question and the answer must both stand in the passage.

Passages overlap by half and are twice as long as the longest item, so one of them holds any item whole.
Whether a passage can reach the threshold at all is bounded for all passages of a piece at once: items are
dealt to a fixed number of blocks, each word has a greatest score in a block, and the sums over the rarer
words of two neighbouring half passages, plus the most that common words can add, bound every block.
Items are indexed in blocks of bounded size, each sent to all tasks; texts never leave their partition.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns, column_of, pieces
from .store import fresh
from .words import FOLDED, find_words, row_shingles, sequence_hashes

THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE_WORDS = 5
INDEX_BYTES = 32 << 20
BLOCK = 64
K1, B = 1.2, 0.75
COMMON = 0.05
_FILTER_BITS = 20
_ITEM_BLOCKS = 256
_HALVES = 4096


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's two parts: up to the last question mark and behind it, or else before and in the
    last line, or else before and in the last sentence. A part without a word gives way to the item."""
    for cut in (r"(?s)(.*\?)(.*)", r"(?s)(.*)\n(.*\S.*)", r"(?s)(.*[.!])\s+(\S.*)"):
        found = re.fullmatch(cut, text.strip())
        if found and all(re.search(r"\w", part) for part in found.groups()):
            return found[1], found[2]
    return text, text


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return find_words(data, np.array([0, len(data)]), FOLDED).hashes


@dataclass
class ItemIndex:
    """Posting lists by word, each in item order, with the greatest score of a list and of its blocks."""

    item_ids: list
    parts: list
    longest: int
    words: np.ndarray
    bounds: list
    items: list
    scores: list
    list_max: np.ndarray
    block_max: list
    block_bounds: list
    common: np.ndarray
    common_bound: np.ndarray
    bound_starts: np.ndarray
    bound_blocks: np.ndarray
    bound_scores: np.ndarray
    seen: np.ndarray = field(repr=False)

    @classmethod
    def build(cls, rows: list[tuple]) -> ItemIndex:
        """Of (item id, text) rows; items without a word are left out."""
        known = [(i, t, word_hashes(t)) for i, t in rows if t]
        known = [(i, t, w) for i, t, w in known if len(w)]
        lengths = np.array([len(w) for _, _, w in known], float)
        mean = lengths.mean() if len(known) else 1.0
        entries = []
        for k, (_, _, w) in enumerate(known):
            terms, times = np.unique(w, return_counts=True)
            weight = times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[k] / mean))
            entries.append((terms, np.full(len(terms), k), weight))
        empty = np.empty(0, np.uint64), np.empty(0, int), np.empty(0)
        terms, items, scores = (np.concatenate(x) for x in zip(*(entries or [empty])))
        order = np.lexsort((items, terms))
        terms, items, scores = terms[order], items[order], scores[order]
        words, starts = np.unique(terms, return_index=True)
        bounds = np.append(starts, len(terms))
        df = np.diff(bounds)
        scores = scores * np.repeat(np.log1p((len(known) - df + 0.5) / (df + 0.5)), df)
        own = np.bincount(items, scores, minlength=len(known))
        scores = scores / own[items] if len(items) else scores
        list_max = np.maximum.reduceat(scores, starts) if len(starts) else scores
        common = df > max(1, COMMON * len(known))
        shared = np.zeros(_ITEM_BLOCKS)
        np.maximum.at(
            shared,
            np.arange(len(known)) % _ITEM_BLOCKS,
            np.bincount(items, scores * np.repeat(common, df), minlength=len(known)),
        )
        places, back = np.unique(np.repeat(np.arange(len(words)), df) * _ITEM_BLOCKS + items % _ITEM_BLOCKS, return_inverse=True)
        bound_scores = np.zeros(len(places))
        np.maximum.at(bound_scores, back, scores)
        bound_starts = np.searchsorted(places, np.arange(len(words) + 1) * _ITEM_BLOCKS)
        block_max, block_bounds = [], [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            block_max += [float(scores[k : min(k + BLOCK, b)].max()) for k in range(a, b, BLOCK)]
            block_bounds.append(len(block_max))
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[words & np.uint64((1 << _FILTER_BITS) - 1)] = True
        return cls(
            [i for i, _, _ in known], [[word_hashes(p) for p in question_and_answer(t)] for _, t, _ in known],
            int(lengths.max()) if len(known) else 0, words, bounds.tolist(), items.tolist(), scores.tolist(), list_max,
            block_max, block_bounds, common, shared, bound_starts, places % _ITEM_BLOCKS, bound_scores, seen,
        )

    def term_numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of indexed words in ``hashes`` and their numbers."""
        at = np.flatnonzero(self.seen[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
        if not len(at) or not len(self.words):
            return at[:0], at[:0]
        numbers = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
        same = self.words[numbers] == hashes[at]
        return at[same], numbers[same]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for the distinct ``terms`` reaches ``threshold``."""
        items, scores, bounds = self.items, self.scores, self.bounds
        limit = threshold - 1e-9
        lists = [[items[bounds[t]], bounds[t], bounds[t + 1], t, float(self.list_max[t])] for t in terms]
        found = []

        def advance(c: list, item: int) -> None:
            c[1] = bisect_left(items, item, c[1], c[2])
            c[0] = items[c[1]] if c[1] < c[2] else None

        while lists:
            lists.sort(key=lambda c: c[0])
            most, pivot = 0.0, -1
            for k, c in enumerate(lists):
                most += c[4]
                if most >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            most, past = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else item + (1 << 60)
            for _, at, end, t, _ in ahead:
                at = bisect_left(items, item, at, end)
                if at < end:
                    block = (at - bounds[t]) // BLOCK
                    most += self.block_max[self.block_bounds[t] + block]
                    past = min(past, items[min(bounds[t] + (block + 1) * BLOCK, end) - 1] + 1)
            if most < limit:
                for c in ahead:
                    advance(c, max(past, item + 1))
            elif ahead[0][0] == item:
                score = sum(scores[c[1]] for c in ahead)
                if score >= limit:
                    found.append((item, score))
                for c in ahead:
                    advance(c, item + 1)
            else:
                for c in ahead:
                    advance(c, item)
            lists = [c for c in lists if c[0] is not None]
        return found


def _promising(index: ItemIndex, at, terms, first, starts, ends, step: int, threshold: float) -> list[int]:
    """Passages whose bound reaches the threshold."""
    halves = int(first[-1]) + 2
    rare = ~index.common[terms]
    place, term = at[rare], terms[rare]
    k = np.searchsorted(starts, place, side="right") - 1
    half = first[k] + (place - starts[k] >= step)
    half, term = np.divmod(np.unique(half * len(index.words) + term), len(index.words))
    found: list[int] = []
    for lowest in range(0, halves, _HALVES):
        low, high = np.searchsorted(half, (lowest, lowest + _HALVES + 1))
        near, words = half[low:high] - lowest, term[low:high]
        counts = index.bound_starts[words + 1] - index.bound_starts[words]
        entry = np.repeat(index.bound_starts[words] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        cells = np.repeat(near, counts) * _ITEM_BLOCKS + index.bound_blocks[entry]
        size = (_HALVES + 1) * _ITEM_BLOCKS
        sums = np.bincount(cells, index.bound_scores[entry], minlength=size).reshape(-1, _ITEM_BLOCKS)
        a, b = np.searchsorted(first, (lowest, lowest + _HALVES))
        mine = first[a:b] - lowest
        most = (sums[mine] + sums[mine + 1] + index.common_bound).max(axis=1)
        found += (a + np.flatnonzero(most >= threshold - 1e-6)).tolist()
    return found


def contained(part: np.ndarray, passage: np.ndarray, length: int) -> float:
    """Share of a part's word runs that stand in the passage."""
    runs = np.unique(row_shingles(part, length))
    return float(np.isin(runs, sequence_hashes(passage, min(length, len(part)))).mean())


def leaks_of_piece(index: ItemIndex, data: np.ndarray, offsets: np.ndarray, threshold: float, overlap: float):
    """(row, item number, score, question overlap, answer overlap) of the verified items, best passage each."""
    words = find_words(data, offsets, FOLDED)
    at, terms = index.term_numbers(words.hashes)
    if not len(at):
        return
    step = max(index.longest, 1)
    size = 2 * step
    counts = np.diff(words.bounds)
    passages = np.where(counts > 0, np.maximum(0, -(-(counts - size) // step)) + 1, 0)
    rows = np.repeat(np.arange(len(counts)), passages)
    turn = np.arange(len(rows)) - np.repeat(np.cumsum(passages) - passages, passages)
    starts = words.bounds[rows] + turn * step
    ends = np.minimum(starts + size, words.bounds[rows + 1])
    low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
    # A row has one half passage more than passages; passage k holds the halves first[k] and first[k] + 1.
    first = np.arange(len(rows)) + rows - np.repeat(np.cumsum(passages == 0), passages)
    best: dict[tuple[int, int], tuple] = {}
    for k in _promising(index, at, terms, first, starts, ends, step, threshold):
        for item, score in index.search(np.unique(terms[low[k] : high[k]]).tolist(), threshold):
            passage = words.hashes[starts[k] : ends[k]]
            question, answer = (contained(p, passage, SHINGLE_WORDS) for p in index.parts[item])
            if question >= overlap and answer >= overlap:
                place = (int(rows[k]), item)
                best[place] = max(best.get(place, (0.0, 0.0, 0.0)), (score, question, answer))
    for (row, item), scores in sorted(best.items()):
        yield row, item, *scores


def _with_block(docs: DataFrame, text: str, name: str, index: ItemIndex, kind: str, threshold: float, overlap: float):
    def make(batch: pa.RecordBatch) -> list:
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for first, data, offsets in pieces(column_of(batch, text)):
            for row, item, score, question, answer in leaks_of_piece(index, data, offsets, threshold, overlap):
                found[first + row].append(
                    {"item_id": index.item_ids[item], "score": score, "question_overlap": question, "answer_overlap": answer}
                )
        return [pa.array(found, pa.list_(_arrow_leak(kind)))]

    return add_columns(docs, f"{name} array<struct<item_id:{kind},score:double,question_overlap:double,answer_overlap:double>>", make)


def _arrow_leak(kind: str) -> pa.DataType:
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    numbers = ("score", "question_overlap", "answer_overlap")
    return pa.struct([("item_id", id_type), *((n, pa.float64()) for n in numbers)])


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    name: str = "leaks",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``docs`` with ``name``: the items (long, int or text ids) found in a text and their scores.

    Words are runs of letters and digits, ASCII letters in lower case. An item counts if its BM25
    score reaches ``threshold`` and at least ``overlap`` of the five-word runs of its question and of
    its answer stand in the same passage (a shorter part must stand there whole). Null and empty texts
    have no items; null or wordless items are in no text; equal items are all found; null item ids are
    kept. A column of ``docs`` called ``name`` is replaced. Empty tables are allowed on both sides.

    Items go to the tasks in blocks of about ``index_bytes`` of text, one pass over ``docs`` for each.
    """
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, ceil(total / index_bytes))
    columns = []
    out = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        index = ItemIndex.build(sorted(((r.i, r.t) for r in block.collect()), key=lambda r: (r[0] is None, r)))
        columns.append(fresh(out, f"leaks_{k}"))
        out = _with_block(out, text, columns[-1], index, kind, threshold, overlap)
    return out.withColumn(name, F.flatten(F.array(*columns))).drop(*(c for c in columns if c != name))
