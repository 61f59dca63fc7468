"""Repeated 100-byte strings removed from texts, found with suffix arrays.

Which bytes go is exact: those of every string of ``length`` bytes that also starts earlier, in a text
with a smaller number or further ahead in the same text.

A window (a string of that length) is told apart by content alone: its anchor is the ``ANCHOR``-byte
string inside it with the smallest hash. Neighbouring windows with the same anchor form a run, and equal
windows always have equal anchors, so all that can match meets in the shard that its anchor's hash names.

1. Anchors are counted; a bitmap of those that occur twice or more goes to all tasks.
2. Tasks cut the texts into runs again. Of equal runs in a batch only the first is sent on, with its bytes;
   the others are known to be repeated.
3. A shard joins its different runs to one text and sorts its suffixes by Larsson-Sadakane refinement:
   a first sort by eight bytes, then groups not yet single are sorted by the rank of what follows, the
   depth doubling each time. Kasai's common prefixes, in lanes that step
   together, cut the order into classes of equal windows. Per class, all but the first window go.
4. Removed stretches return to their texts.

Shards are merged by their anchors, so no suffix is searched in another shard: searching every suffix in
every shard would grow with the square of the number of shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialise

from .batches import add_columns, column_of, pieces, text_bytes
from .store import fresh
from .words import _VALUES, _power_tables, mix

LENGTH = 100
ANCHOR = 24
SHARD_BYTES = 4 << 20
MAX_BITS = 30
_PLACE = np.uint64((1 << 24) - 1)
_PART = 1 << 23


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of the windows of a piece: row, first window, number of windows, hash of anchor and of bytes."""
    n, reach = len(data), length - ANCHOR + 1
    found: list[dict[str, np.ndarray]] = []
    for low in range(0, max(0, n - length + 1), _PART):  # places have 24 bits
        part = data[low : low + _PART + length - 1]
        size = len(part) - length + 1
        power, inverse = _power_tables(len(part) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[part] * power[: len(part)])))
        count = len(part) - ANCHOR + 1
        hashes = mix((total[ANCHOR:] - total[:-ANCHOR]) * inverse[:count])
        keyed = (hashes & ~_PLACE) | np.arange(count, dtype=np.uint64)
        blocks = np.concatenate((keyed, np.full(-count % reach, ~np.uint64(0)))).reshape(-1, reach)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchors = (np.minimum(behind[:size], ahead[reach - 1 : reach - 1 + size]) & _PLACE).astype(np.int64)
        # Windows inside a row, and the row of each.
        edge = np.zeros(size + 1, np.int64)
        begins, ends = offsets[:-1] - low, offsets[1:] - low - length + 1
        begins, ends = np.clip(begins, 0, size), np.clip(ends, 0, size)
        whole = ends > begins
        np.add.at(edge, begins[whole], 1)
        np.add.at(edge, ends[whole], -1)
        inside = np.cumsum(edge[:-1]) > 0
        new = np.ones(size, bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (inside[1:] != inside[:-1])
        new[begins[whole & (begins < size)]] = True
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], size)
        starts, stops = starts[inside[starts]], stops[inside[starts]]
        # The smallest hashes of windows crowd at the low end: hashed once more, they spread evenly.
        anchor = mix(hashes[anchors[starts]] * np.uint64(0x9E3779B97F4A7C15))
        content = mix((total[stops + length - 1] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        # The offset of the anchor tells runs apart that hold the same bytes around different anchors.
        content = mix(content + (anchors[starts] - starts).astype(np.uint64))
        first = starts + low
        row = np.searchsorted(offsets, first, side="right") - 1
        found.append({"row": row, "first": first, "count": stops - starts, "anchor": anchor, "content": content})
    if not found:
        empty = np.empty(0, np.int64)
        return {"row": empty, "first": empty, "count": empty, "anchor": empty.astype(np.uint64), "content": empty.astype(np.uint64)}
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _anchor_counts(rows: DataFrame, length: int) -> DataFrame:
    """Anchors of runs and how often they occur, at most two per task's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_runs(d, o, length)["anchor"] for _, d, o in pieces(column_of(batch, "text"))]
            if found:
                anchors, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], ["anchor", "n"]
                )

    return rows.select("text").mapInArrow(run, "anchor long, n int")


def _bitmap(repeated: DataFrame, bits: int) -> np.ndarray:
    """One bit for the leading ``bits`` bits of each anchor, combined on the cluster."""
    place = F.shiftrightunsigned("anchor", 64 - bits)
    cells = repeated.groupBy(F.shiftrightunsigned(place, 6).alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(anchor, {64 - bits}) & 63))")).alias("bits")
    )
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    found = cells.toArrow()
    bitmap[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return bitmap.view(np.uint64)


def _marked(bitmap: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    place = anchors >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


_RUN = pa.schema(
    [("shard", pa.int64()), ("late", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("first", pa.int64()),
     ("count", pa.int32()), ("content", pa.int64()), ("bytes", pa.binary())]
)
_RUN_COLUMNS = "shard long, late boolean, doc_id long, tie long, first long, count int, content long, bytes binary"


def _stretches(order: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of a text, joined: text, begin and end."""
    by = np.lexsort((first, order))
    order, first, last = order[by], first[by], last[by]
    if not len(order):
        return order, first, last
    # Texts are laid far apart, so that one running maximum serves all.
    span = int(last.max()) + 2
    reach = np.maximum.accumulate(last + np.cumsum(np.append(True, order[1:] != order[:-1])) * span)
    base = np.cumsum(np.append(True, order[1:] != order[:-1])) * span
    new = np.ones(len(order), bool)
    new[1:] = first[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return order[at], first[at], (reach - base)[np.append(at[1:], len(order)) - 1]


def _candidates(rows: DataFrame, bitmap: np.ndarray, bits: int, length: int) -> DataFrame:
    """Runs whose anchor may occur elsewhere, of equal ones in a batch the first; and what the others remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = column_of(batch, "text")
            ids, tie = (column_of(batch, n) for n in ("doc_id", "tie"))
            late = np.asarray(ids.is_null())
            number, tie = ids.fill_null(0).to_numpy(), tie.to_numpy()
            order = np.empty(len(text), np.int64)
            order[np.lexsort((tie, number, late))] = np.arange(len(text))
            same = np.lexsort((tie, number, late))
            moved = np.any([x[same[1:]] != x[same[:-1]] for x in (late, number, tie)], axis=0)
            order[same] = np.cumsum(np.append(0, moved))  # repeated rows are one text
            data, offsets = text_bytes(text)
            found = []
            for start, part, bounds in pieces(text):
                runs = _runs(part, bounds, length)
                hit = _marked(bitmap, runs["anchor"], bits)
                runs = {k: v[hit] for k, v in runs.items()}
                runs["first"] = runs["first"] - bounds[runs["row"]]
                runs["row"] = runs["row"] + start
                found.append(runs)
            runs = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            by = np.lexsort((runs["first"], order[runs["row"]], runs["content"], runs["anchor"]))
            runs = {k: v[by] for k, v in runs.items()}
            place = order[runs["row"]]
            head = np.ones(len(by), bool)
            head[1:] = (runs["anchor"][1:] != runs["anchor"][:-1]) | (runs["content"][1:] != runs["content"][:-1])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
            again = (place != place[lead]) | (runs["first"] != runs["first"][lead])
            sent = np.flatnonzero(head)
            row, first, count = runs["row"][sent], runs["first"][sent], runs["count"][sent]
            begin = offsets[row] + first
            raw = data.tobytes()
            content = [raw[a : a + n] for a, n in zip(begin.tolist(), (count + length - 1).tolist())]
            for a in range(0, len(sent), 20000):
                b = slice(a, a + 20000)
                columns = [
                    pa.array(runs["anchor"][sent][b].view(np.int64)), pa.array(late[row[b]]), pa.array(number[row[b]]),
                    pa.array(tie[row[b]]), pa.array(first[b]), pa.array(count[b].astype(np.int32)),
                    pa.array(runs["content"][sent][b].view(np.int64)), pa.array(content[b], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_RUN)
            row, first, last = _stretches(runs["row"][again], runs["first"][again], (runs["first"] + runs["count"])[again] + length - 1)
            spread = mix(tie[row].view(np.uint64) + first.astype(np.uint64)).view(np.int64)
            nothing = pa.nulls(len(row), pa.binary())
            columns = [
                pa.array(spread), pa.array(late[row]), pa.array(number[row]), pa.array(tie[row]), pa.array(first),
                pa.array((last - first).astype(np.int32)), pa.array(np.zeros(len(row), np.int64)), nothing,
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_RUN)

    return rows.mapInArrow(run, _RUN_COLUMNS)


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, a shorter one before those it begins, and the place of each in the order."""
    n = len(data)
    order = np.argsort(packed(data, ">u8")).astype(np.int64)
    ranked = packed(data, ">u8")[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 8
    while True:
        # Groups of one are done; the others are sorted by what stands ``depth`` bytes further on.
        tail = np.append(head[1:], True)
        open_ = np.flatnonzero(~(head & tail))
        if not len(open_):
            return order, rank[:n]
        at = order[open_]
        key = rank[at] * np.int64(1 << 32) + rank[np.minimum(at + depth, n)] + 1
        by = np.argsort(key)
        order[open_] = at = at[by]
        key = key[by]
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        head[open_] = new
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        depth *= 2


def packed(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded.view(), (len(data), 8), (1, 1)).copy().view(kind).ravel().astype(np.uint64)


def common_prefixes(data: np.ndarray, order: np.ndarray, place: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in order, ``most`` at most.

    Kasai's walk through the text, where a place shares at least one byte less than the place before
    it; every lane walks a stretch of the text and all lanes take their steps together.
    """
    n = len(data)
    lanes = max(1, min(lanes, n // 64))
    size = -(-n // lanes)
    words = np.concatenate((packed(np.concatenate((data, np.zeros(most + 8, np.uint8))), "<u8"), np.zeros(8, np.uint64)))
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    at = np.arange(lanes) * size
    held = np.zeros(lanes, np.int64)
    for step in range(size):
        here = at + step
        lane = np.flatnonzero(here < n)
        other = previous[here[lane]]
        lane, other = lane[other >= 0], other[other >= 0]
        held = np.maximum(held - 1, 0)
        stopped = np.ones(lanes, bool)
        stopped[lane] = False
        held[stopped] = 0
        while len(lane):
            differ = words[here[lane] + held[lane]] ^ words[other + held[lane]]
            low = differ & (~differ + np.uint64(1))
            more = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            held[lane] = np.minimum(held[lane] + more, most)
            open_ = (differ == 0) & (held[lane] < most)
            lane, other = lane[open_], other[open_]
        inside = here < n
        shared[here[inside]] = held[inside]
    return shared


def repeated_windows(texts: list[bytes], counts: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the first ``counts`` windows of each text, those equal to one with a smaller place.

    ``starts`` holds the place of each text's first window; the next windows follow it. Window flags
    come in the order of the texts.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    order, place = suffix_array(data)
    shared = common_prefixes(data, order, place, length)
    classes = np.cumsum(shared[order] < length)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.repeat(begins, counts) + inside
    global_place = np.repeat(starts, counts) + inside
    mine = classes[place[windows]]
    least = np.full(classes[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, mine, global_place)
    return global_place > least[mine]


def _shard_removals(rows: list[dict[str, np.ndarray]], length: int):
    """(late, number, tie, begin, end) of what the runs of a shard remove."""
    column = {k: np.concatenate([r[k] for r in rows]) for k in ("shard", "late", "doc_id", "tie", "first", "count", "content")}
    content = [b for r in rows for b in r["bytes"]]
    n = len(column["shard"])
    by = np.lexsort((column["tie"], column["doc_id"], column["late"]))
    moved = np.any([column[k][by[1:]] != column[k][by[:-1]] for k in ("tie", "doc_id", "late")], axis=0)
    text = np.empty(n, np.int64)
    text[by] = np.cumsum(np.append(0, moved))
    place = (text << 32) + column["first"]
    # Of equal runs only the first enters the suffix array; the others are removed whole.
    by = np.lexsort((place, column["content"], column["shard"]))
    head = np.ones(n, bool)
    head[1:] = (column["shard"][by[1:]] != column["shard"][by[:-1]]) | (column["content"][by[1:]] != column["content"][by[:-1]])
    lead = by[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
    again = by[place[by] > place[lead]]
    unique = by[head]
    begin, end = [column["first"][again]], [column["first"][again] + column["count"][again] + length - 1]
    owner = [again]
    # Runs of different anchors never match: a part of the anchors is a shard of its own.
    sizes = np.array([len(content[k]) for k in unique.tolist()])
    parts = np.cumsum(sizes) // SHARD_BYTES
    anchors = column["shard"][unique]
    starts = np.concatenate(([0], np.flatnonzero((parts[1:] != parts[:-1])) + 1))
    starts = np.unique([np.searchsorted(anchors, anchors[s]) for s in starts])
    for a, b in zip(starts, np.append(starts[1:], len(unique))):
        chosen = unique[a:b]
        counts = column["count"][chosen].astype(np.int64)
        flags = repeated_windows([content[k] for k in chosen.tolist()], counts, place[chosen], length)
        run = np.repeat(np.arange(len(chosen)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        new = flags.copy()
        new[1:] &= ~(flags[:-1] & (run[1:] == run[:-1]))
        last = flags.copy()
        last[:-1] &= ~(flags[1:] & (run[1:] == run[:-1]))
        owner.append(chosen[run[new]])
        begin.append(column["first"][chosen[run[new]]] + inside[new])
        end.append(column["first"][chosen[run[last]]] + inside[last] + length)
    owner, begin, end = np.concatenate(owner), np.concatenate(begin), np.concatenate(end)
    which, begin, end = _stretches(text[owner], begin, end)
    sample = np.empty(text.max() + 1, np.int64)
    sample[text] = np.arange(n)
    rows = sample[which]
    return column["late"][rows], column["doc_id"][rows], column["tie"][rows], begin, end


def _removals(candidates: DataFrame, length: int) -> DataFrame:
    names = ["late", "doc_id", "tie", "begin", "end"]

    def out(late, number, tie, begin, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (late, number, tie, begin, end)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = np.asarray(column_of(batch, "bytes").is_null())
            if known.any():
                rows = batch.filter(pa.array(known))
                late, number, tie, first, count = (column_of(rows, n).to_numpy(zero_copy_only=False) for n in ("late", "doc_id", "tie", "first", "count"))
                yield out(late, number, tie, first, first + count)
            if not known.all():
                rows = batch.filter(pa.array(~known))
                one = {k: column_of(rows, k).to_numpy(zero_copy_only=False) for k in _RUN.names[:-1]}
                held.append(one | {"bytes": column_of(rows, "bytes").to_pylist()})
        if held:
            yield out(*_shard_removals(held, length))

    return candidates.mapInArrow(run, "late boolean, doc_id long, tie long, begin long, end long")


def _with_kept(docs: DataFrame, text: str, begins: str, ends: str) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list:
        data, offsets = text_bytes(column_of(batch, text))
        raw = data.tobytes()
        lists = [column_of(batch, n).to_pylist() for n in (begins, ends)]
        sizes, removed, spans, digests = [], [], [], []
        for k, (first, last) in enumerate(zip(*lists)):
            whole = raw[offsets[k] : offsets[k + 1]]
            gone, count, kept, at = 0, 0, [], 0
            if first:
                _, first, last = _stretches(np.zeros(len(first), np.int64), np.array(first), np.array(last))
                for a, b in zip(first.tolist(), last.tolist()):
                    kept.append(whole[at:a])
                    gone, count, at = gone + b - a, count + 1, b
            kept.append(whole[at:])
            sizes.append(len(whole))
            removed.append(gone)
            spans.append(count)
            digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
        return [*(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())]

    return add_columns(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", make, without=(text, begins, ends))


def repeated_stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``begins`` and ``ends``: the stretches of bytes to remove, null if there are none.

    Texts count as UTF-8 bytes, null as empty; texts shorter than ``length`` lose nothing. Rows that
    repeat number and text are one text and lose the same; texts with one number are in the order of
    their digests; a null number comes after all others. Matches never cross texts. Other columns stay,
    those called ``begins`` or ``ends`` are replaced. An empty table gives an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    tie = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tie.alias("tie"), whole.alias("text"))
    counts = _anchor_counts(rows, length).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = materialise(counts, "anchors")
    size, runs = repeated.agg(F.count("*"), F.sum("n")).first()
    bits = min(MAX_BITS, max(16, ceil(log2(32 * max(size, 1)))))
    candidates = _candidates(rows, _bitmap(repeated, bits), bits, length)
    shards = max(1, ceil((runs or 0) * (length + 36) / SHARD_BYTES))
    removed = _removals(candidates.repartition(shards, "shard"), length)
    lists = removed.groupBy("late", "doc_id", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    lists = materialise(lists.select("late", "doc_id", "tie", "s.begin", "s.end"), "stretches")
    mark = fresh(docs, "text_mark")
    out = docs.drop(*[c for c in docs.columns if c.lower() in ("begins", "ends")]).withColumn(mark, tie)
    number = F.when(F.col("late"), F.lit(None)).otherwise(F.col("doc_id"))
    lists = lists.select(F.col("tie").alias("t"), number.alias("d"), F.col("begin").alias("begins"), F.col("end").alias("ends"))
    return out.join(lists, (F.col(mark) == F.col("t")) & F.col(doc_id).cast("long").eqNullSafe(F.col("d")), "left").drop(mark, "t", "d")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the digest of the bytes that stay, per row."""
    found = repeated_stretches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), length=length)
    return _with_kept(found, "text", "begins", "ends")
