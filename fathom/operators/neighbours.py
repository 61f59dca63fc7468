"""Exact nearest neighbours without comparing all pairs.

Donors are split into cells by a tree grown on a few of them: by the text that parts most pairs first,
then at medians. The donors of a cell are stored once, packed, in the shared folder. Queries of a cell are
searched together: first in their own cell, then in the others from the nearest bounding box on, and only while
a box is not farther than the k-th donor found so far. Within a cell, texts and the features that differ most
give a bound for every pair by array arithmetic; only pairs that it cannot rule out are compared in full.
No donor is left out: the tree and the bounds steer the work, not the result.
"""

from __future__ import annotations

import heapq
import json
import pickle
import re
import sys
import uuid
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import names_sql, quoted
from ..session import materialise, new_path

# Executors get this module with the functions below, and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_CELLS = 4096
CELL_ROWS = 2000
BLOCK_ROWS = 20000
# Queries of a cell that a task searches together, and that array arithmetic takes at a time.
QUERY_ROWS = 1000
QUERY_BATCH = 256
# Queries with the same texts from so many on are taken on their own: their texts rule out donors at once.
ALIKE = 16
MAX_TASKS = 4096
# Bytes of unpacked donors that a task keeps for its next queries.
KEPT_BYTES = 128 << 20
# Features that bound a pair's distance before it is compared in full.
BOUND_FEATURES = 16
# Donors that the tree is grown on, and the values a text may have to be split by.
SAMPLE_ROWS = 20000
MAX_VALUES = 64
# Pairs bounded, and pairs compared in full, at a time: they fit a processor cache.
BATCH_PAIRS = 131072
FULL_PAIRS = 2048
# From so many pairs on, donors are met by the number of texts that differ.
LEVEL_PAIRS = 4096
SLACK = 1e-9
DIGITS = 12


@dataclass
class Ready:
    """Rows by feature: numbers (scaled, 0 where missing), codes of texts, and which values are there."""

    numbers: np.ndarray
    codes: np.ndarray
    there: np.ndarray
    named: np.ndarray

    def part(self, rows: np.ndarray | slice) -> "Ready":
        return Ready(self.numbers[:, rows], self.codes[:, rows], self.there[rows], self.named[rows])


@dataclass
class Space:
    """How two rows are compared: mean scaled difference with mismatches, or straight-line distance."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    ranges: dict[str, float] = field(default_factory=dict)
    euclidean: bool = False

    def arrays(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        numbers = rows[list(self.numeric)].to_numpy(dtype=float)
        texts = rows[list(self.categorical)].to_numpy(dtype=object)
        return numbers, texts

    def ready(self, rows: pd.DataFrame) -> "Ready":
        """What distances need of these rows, worked out once however many batches they meet."""
        numbers, texts = self.arrays(rows)
        there = ~np.isnan(numbers)
        if self.euclidean:
            return Ready(numbers.T.copy(), np.empty((0, len(rows)), np.int64), there, np.empty((len(rows), 0), bool))
        widths = np.array([self.ranges.get(name) or 0.0 for name in self.numeric], float)
        scaled = np.where(there, numbers, 0.0) / np.where(widths > 0, widths, np.inf)
        named = ~pd.isna(texts) if texts.size else np.ones(texts.shape, bool)
        codes = [pd.util.hash_array(texts[:, j].astype(str).astype(object)).view(np.int64) for j in range(texts.shape[1])]
        return Ready(scaled.T.copy(), np.array(codes, np.int64).reshape(texts.shape[1], len(rows)), there, named)

    def distances(self, a: "Ready", b: "Ready") -> np.ndarray:
        """Distances of all rows of ``a`` to all rows of ``b``; 1 where no feature is known of both.

        Sums run over all features with 0 for what is missing; what pairs with a missing value have
        thereby added is known from each row alone and taken off by matrix products.
        """
        total = np.zeros((a.there.shape[0], b.there.shape[0]))
        gap = np.empty_like(total)
        # Features that are mostly zeros: sizes of both sides, summed once, put right where both differ from zero.
        sizes = np.zeros(total.shape[0]), np.zeros(total.shape[1])
        for left, right in zip(a.numbers, b.numbers):
            if not self.euclidean:
                one, two = np.flatnonzero(left), np.flatnonzero(right)
                if 8 * len(one) * len(two) < total.size:
                    left, right = left[one], right[two]
                    sizes[0][one] += np.abs(left)
                    sizes[1][two] += np.abs(right)
                    if len(one) and len(two):
                        pair = np.abs(left[:, None] - right[None, :]) - np.abs(left)[:, None] - np.abs(right)[None, :]
                        total[np.ix_(one, two)] += pair
                    continue
            np.subtract(left[:, None], right[None, :], out=gap)
            np.square(gap, out=gap) if self.euclidean else np.abs(gap, out=gap)
            total += gap
        if self.euclidean:
            return np.sqrt(total)
        total += sizes[0][:, None]
        total += sizes[1][None, :]
        for left, right, here, beyond in zip(a.codes, b.codes, a.named.T, b.named.T):
            unequal = left[:, None] != right[None, :]
            unequal[~here] = False
            unequal[:, ~beyond] = False
            total += unequal
        for one, two, turn in ((a, b, False), (b, a, True)):
            if not one.there.all():
                added = (~one.there).astype(float) @ (np.abs(two.numbers) * two.there.T)
                total -= added.T if turn else added
        known = a.there.astype(float) @ b.there.T.astype(float) + a.named.astype(float) @ b.named.T.astype(float)
        # Equal distances stay equal in whatever order they were summed.
        total /= np.maximum(known, 1.0)
        np.round(total, DIGITS, out=total)
        total[known == 0] = 1.0
        return total

    def lower_bounds(self, rows: "Ready", boxes: "Boxes") -> np.ndarray:
        """A distance that no donor of a box can fall below: what the split features alone make."""
        total = np.zeros((len(rows.there), len(boxes.cells)))
        for place, j in enumerate(boxes.split):
            x = rows.numbers[j][:, None]
            low, high, null = boxes.low[place], boxes.high[place], boxes.null[place]
            gap = np.maximum(np.maximum(low - x, x - high), 0.0)
            gap[:, null] = 0.0
            gap[~rows.there[:, j]] = 0.0
            total += gap * gap if self.euclidean else gap
        if self.euclidean:
            return np.sqrt(total)
        for j, codes in enumerate(rows.codes):
            unequal = codes[:, None] != boxes.codes[j][None, :]
            unequal[:, ~boxes.single[j]] = False
            unequal[~rows.named[:, j]] = False
            total += unequal
        present = rows.there.sum(axis=1) + rows.named.sum(axis=1)
        return total / np.maximum(present, 1.0)[:, None]


@dataclass
class Boxes:
    """Size and bounds of each cell: of the features that cells are split by, and of texts with one value."""

    cells: np.ndarray
    groups: np.ndarray
    rows: np.ndarray
    split: list[int]
    low: list[np.ndarray]
    high: list[np.ndarray]
    null: list[np.ndarray]
    codes: np.ndarray
    single: np.ndarray

    def part(self, at: np.ndarray) -> "Boxes":
        low, high, null = ([x[at] for x in bounds] for bounds in (self.low, self.high, self.null))
        return Boxes(
            self.cells[at], self.groups[at], self.rows[at], self.split, low, high, null, self.codes[:, at], self.single[:, at]
        )


@dataclass
class Split:
    """A node of the tree: a text with one child per value and one for the rest, or a number with two children.

    Numbers that are missing go with the smaller ones. A child is a node or the number of a cell.
    """

    column: int
    values: list | None
    at: float
    children: list


def nearest_rows(
    queries: DataFrame,
    donors: DataFrame,
    key: str,
    space: Space,
    k: int = 5,
    targets: Sequence[str] = (),
    within: str | None = None,
    cell_rows: int = CELL_ROWS,
    distinct_keys: bool = False,
) -> DataFrame:
    """The k nearest donors of every query, ties by donor key: key, target, donor, distance, value, rank.

    ``targets``: numeric columns to look up instead; for each of them that the query lacks, the
    nearest donors that have it. ``within`` names a small column that donor and query must share.
    A row is never its own neighbour. ``distinct_keys`` says that no two queries share a key.
    """
    columns = list(dict.fromkeys([*space.numeric, *space.categorical, *targets]))
    take = [quoted(key).cast("string").alias("_key"), *names_sql(columns)]
    group = F.lit("") if within is None else F.coalesce(quoted(within).cast("string"), F.lit(""))
    donors = donors.select(*take, group.alias("_group"))
    queries = queries.select(*take, group.alias("_group"))

    sizes = {r["_group"]: r["count"] for r in donors.groupBy("_group").count().limit(MAX_CELLS + 1).collect()}
    if len(sizes) > MAX_CELLS:
        raise ValueError(f"{within} has more than {MAX_CELLS} values")
    sample = _sample(donors, sum(sizes.values()))
    trees, split = _trees(donors, sizes, space, cell_rows, sample)
    donors = materialise(_assigned(donors, trees, space), "donors")
    boxes = _boxes(donors, space, split)
    near = materialise(_assigned(queries, trees, space), "queries")
    asked, wanted = _asked(near, targets)
    blocks = _packed(donors, boxes, space, wanted, cell_rows)
    found = _searched(near, asked, blocks, boxes, space, _bounding(sample, space), k, wanted, bool(targets))
    if not distinct_keys:
        best = Window.partitionBy("_key", "target").orderBy("distance", "donor")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.withColumnRenamed("_key", key)


def _sample(donors: DataFrame, total: int) -> pd.DataFrame:
    """A few donors, the same however they are partitioned: for what steers the work."""
    scale = 1 << 20
    share = min(scale, -(-SAMPLE_ROWS * scale // max(total, 1)))
    drawn = donors.where(F.pmod(F.xxhash64(F.lit(11), *names_sql(donors.columns)), F.lit(scale)) < share)
    return drawn.limit(4 * SAMPLE_ROWS).toPandas()


def _trees(
    donors: DataFrame, sizes: dict[str, int], space: Space, cell_rows: int, sample: pd.DataFrame | None = None
) -> tuple[dict[str, "Split | int"], list[int]]:
    """A tree for each group, its cells numbered through, and the numeric features that any of them splits."""
    total = sum(sizes.values())
    trees: dict[str, Split | int] = {g: cell for cell, g in enumerate(sorted(sizes))}
    large = [g for g, n in sizes.items() if n > 1.5 * cell_rows]
    if not large:
        return trees, []
    scale = 1 << 20
    share = min(scale, -(-SAMPLE_ROWS * scale // total))
    sample = _sample(donors, total) if sample is None else sample
    numbers, texts = space.arrays(sample)
    codes, names = np.empty(texts.shape, int), []
    for j in range(texts.shape[1]):
        codes[:, j], values = pd.factorize(np.where(pd.isna(texts[:, j]), None, texts[:, j]), use_na_sentinel=False)
        names.append([None if pd.isna(v) else v for v in values])
    widths = np.array([1.0 if space.euclidean else space.ranges.get(name) or np.inf for name in space.numeric], float)
    owner = sample["_group"].to_numpy(dtype=object)
    split: set[int] = set()
    cells = len(trees)
    for g in large:
        limit = min(4 * -(-sizes[g] // cell_rows), max(1, MAX_CELLS * sizes[g] // total))
        mine = np.flatnonzero(owner == g)
        trees[g], cells = _grown(mine, numbers / widths, codes, names, scale / share, cell_rows, limit, cells, split)
    for node in [t for t in trees.values() if isinstance(t, Split)]:
        _unscaled(node, widths)
    return trees, sorted(split)


def _grown(
    rows: np.ndarray, numbers: np.ndarray, codes: np.ndarray, names: list[list], weight: float, cell_rows: int, limit: int,
    cell: int, split: set[int],
) -> tuple["Split | int", int]:
    """The tree of one group, its largest nodes split first, and the next free cell number."""
    root: list = [None]
    waiting = [(-len(rows), 0, root, 0, rows)]
    leaves = pushed = 1
    while waiting:
        _, _, holder, place, own = heapq.heappop(waiting)
        made = _best_split(own, numbers, codes, names) if len(own) * weight > cell_rows and leaves < limit else None
        if made is None or leaves + len(made[1]) - 1 > limit:
            holder[place], cell = cell, cell + 1
            continue
        node, parts = made
        if node.values is None:
            split.add(node.column)
        holder[place] = node
        leaves += len(parts) - 1
        for i, part in enumerate(parts):
            heapq.heappush(waiting, (-len(part), pushed, node.children, i, part))
            pushed += 1
    return root[0], cell


def _best_split(rows: np.ndarray, numbers: np.ndarray, codes: np.ndarray, names: list[list]) -> tuple[Split, list[np.ndarray]] | None:
    """By the feature in which two of the rows differ most."""
    best, choice = 0.0, None
    for j in range(codes.shape[1]):
        counts = np.bincount(codes[rows, j])
        differ = 1.0 - float(np.square(counts / len(rows)).sum())
        if np.count_nonzero(counts) <= MAX_VALUES and differ > best:
            best, choice = differ, ("text", j)
    if numbers.shape[1]:
        block = numbers[rows]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            middle = np.nanmedian(block, axis=0)
            # Cells that hold a missing value are not ruled out by that feature.
            spread = np.nan_to_num(np.nanmean(np.abs(block - middle), axis=0)) * (1 - np.isnan(block).mean(axis=0)) ** 2
        j = int(spread.argmax())
        if spread[j] > best:
            best, choice = float(spread[j]), ("number", j)
    if choice is None:
        return None
    kind, j = choice
    if kind == "text":
        seen = np.flatnonzero(np.bincount(codes[rows, j]))
        parts = [rows[codes[rows, j] == c] for c in seen]
        return Split(j, [names[j][c] for c in seen], 0.0, [None] * (len(seen) + 1)), [*parts, rows[:0]]
    x = numbers[rows, j]
    at = middle[j]
    if not (x > at).any():
        at = x[x < at].max()
    above = x > at
    return Split(j, None, float(at), [None, None]), [rows[~above], rows[above]]


def _unscaled(node: "Split | int", widths: np.ndarray) -> None:
    if isinstance(node, Split):
        if node.values is None:
            node.at *= widths[node.column]
        for child in node.children:
            _unscaled(child, widths)


def _place(node: "Split | int", rows: np.ndarray, numbers: np.ndarray, texts: np.ndarray, cells: np.ndarray) -> None:
    if not isinstance(node, Split):
        cells[rows] = node
    elif len(rows):
        if node.values is None:
            branch = (numbers[rows, node.column] > node.at).astype(int)
        else:
            x = texts[rows, node.column]
            branch = np.full(len(rows), len(node.values))
            for i, value in enumerate(node.values):
                branch[pd.isna(x) if value is None else x == value] = i
        for i, child in enumerate(node.children):
            _place(child, rows[branch == i], numbers, texts, cells)


def _assigned(rows: DataFrame, trees: dict[str, "Split | int"], space: Space) -> DataFrame:
    """Add the cell of the row's group that the tree leads to; rows of a group without donors go."""
    if not any(isinstance(t, Split) for t in trees.values()):
        cells = rows.sparkSession.createDataFrame(list(trees.items()), "_group string, _cell int")
        return rows.join(cells, "_group").select(*rows.columns, "_cell")
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType())])

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            numbers, texts = space.arrays(part)
            cells = np.full(len(part), -1, "int32")
            for group, own in part.groupby("_group", sort=False).indices.items():
                _place(trees.get(group, -1), own, numbers, texts, cells)
            yield _plain(part.assign(_cell=cells)[cells >= 0])

    return rows.mapInPandas(assign, schema)


def _boxes(donors: DataFrame, space: Space, split: list[int]) -> Boxes:
    """Bounds of each cell: at most a few thousand rows."""
    bounds = []
    names = names_sql(space.numeric)
    for j in split:
        c = f"CAST({names[j]} AS DOUBLE)"
        bounds += [
            F.expr(f"min({c}) AS low_n{j}"), F.expr(f"max({c}) AS high_n{j}"),
            F.expr(f"count_if({c} IS NULL OR isnan({c})) > 0 AS null_n{j}"),
        ]
    for j, c in enumerate(names_sql(space.categorical)):
        same = f"min({c}) = max({c}) AND count_if({c} IS NULL) = 0"
        bounds.append(F.expr(f"CASE WHEN {same} THEN min({c}) END AS single_c{j}"))
    found = donors.groupBy("_cell", "_group").agg(F.count(F.lit(1)).alias("_rows"), *bounds)
    table = found.toPandas().sort_values("_cell").reset_index(drop=True)
    widths = [1.0 if space.euclidean else space.ranges.get(space.numeric[j]) or np.inf for j in split]
    low, high = ([table[f"{end}_n{j}"].to_numpy(dtype=float) / w for j, w in zip(split, widths)] for end in ("low", "high"))
    singles = np.array([table[f"single_c{j}"].to_numpy(dtype=object) for j in range(len(space.categorical))], object)
    singles = singles.reshape(len(space.categorical), len(table))
    codes = [pd.util.hash_array(x.astype(str).astype(object)).view(np.int64) for x in singles]
    return Boxes(
        table["_cell"].to_numpy(dtype="int32"), table["_group"].to_numpy(dtype=object), table["_rows"].to_numpy(dtype=int), split,
        low, high, [table[f"null_n{j}"].to_numpy(dtype=bool) for j in split],
        np.array(codes, np.int64).reshape(singles.shape), ~pd.isna(singles) if singles.size else np.zeros(singles.shape, bool),
    )


def _routed(rows: DataFrame, boxes: Boxes, space: Space, targets: Sequence[str]) -> DataFrame:
    """Each query with the further cells that may hold a closer donor, if there are any."""
    kept = [f for f in rows.schema.fields if f.name not in ("_reach", "_found", "_cell")]
    schema = T.StructType([*kept, T.StructField("_cells", T.ArrayType(T.IntegerType()))])

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, rows_ in _batches(part, len(boxes.cells)):
                bound = space.lower_bounds(space.ready(rows_), boxes)
                reach = rows_["_reach"].to_numpy(dtype=float)
                wanted = rows_[list(targets)].isna().sum(axis=1).to_numpy() if targets else np.ones(len(rows_))
                complete = np.nan_to_num(rows_["_found"].to_numpy(dtype=float)) >= wanted
                reach = np.where(np.isnan(reach) | ~complete, np.inf, reach)
                open_ = bound <= reach[:, None] + SLACK
                open_ &= rows_["_group"].to_numpy()[:, None] == boxes.groups[None, :]
                open_ &= rows_["_cell"].to_numpy()[:, None] != boxes.cells[None, :]
                cells = pd.Series([boxes.cells[line] for line in open_], index=rows_.index, dtype=object)
                found = rows_.drop(columns=["_reach", "_found", "_cell"]).assign(_cells=cells)
                yield _plain(found[open_.any(axis=1)])

    return rows.mapInPandas(route, schema)


def _asked(near: DataFrame, targets: Sequence[str]) -> tuple[dict[int, int], list[str]]:
    """Queries of each cell, and the targets that any query lacks."""
    lacks = [F.expr(f"count_if({c} IS NULL OR isnan(CAST({c} AS DOUBLE))) AS t{i}") for i, c in enumerate(names_sql(targets))]
    found = near.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *lacks).collect()
    return {r["_cell"]: r["n"] for r in found}, [t for i, t in enumerate(targets) if any(r[f"t{i}"] for r in found)]


@dataclass
class Rows:
    """Rows in donor order with the values that queries may want of them; missing numbers are 0 in ``numbers``."""

    keys: np.ndarray
    numbers: np.ndarray
    there: np.ndarray
    codes: np.ndarray
    named: np.ndarray
    values: np.ndarray

    def part(self, at: np.ndarray | slice) -> "Rows":
        return Rows(self.keys[at], self.numbers[at], self.there[at], self.codes[:, at], self.named[at], self.values[at])


def _rows(part: pd.DataFrame, space: Space, wanted: Sequence[str]) -> Rows:
    """A number that is missing leaves a row out of straight-line distances."""
    keys = part["_key"].to_numpy(dtype=object)
    ready = space.ready(part)
    rows = Rows(keys, ready.numbers.T.copy(), ready.there, ready.codes, ready.named, part[list(wanted)].to_numpy(dtype=float))
    return rows.part(np.flatnonzero(ready.there.all(axis=1))) if space.euclidean else rows


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def _part(parts: dict[int, int], columns: Sequence[str]) -> Column:
    """A row's part of its cell, by its hash; the parts of each cell are looked up by its number."""
    listed = [parts.get(c, 1) for c in range(max(parts, default=-1) + 1)]
    count = F.coalesce(F.get(F.from_json(F.lit(json.dumps(listed)), "array<int>"), F.col("_cell")), F.lit(1))
    return F.pmod(F.xxhash64(*names_sql(columns)), count).cast("int")


def _packed(
    donors: DataFrame, boxes: Boxes, space: Space, wanted: Sequence[str], cell_rows: int
) -> dict[int, list[tuple[str, int]]]:
    """The donors of each cell as files in the shared folder, of bounded size: name and bytes of each.

    Tasks read the cells they need, however many queries want them; a name belongs to one attempt of a task.
    """
    folder = new_path(donors.sparkSession, "cells")
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)
    parts = {int(c): -(-int(n) // max(cell_rows, BLOCK_ROWS)) for c, n in zip(boxes.cells, boxes.rows)}
    cut = donors.withColumn("_block", _part(parts, donors.columns))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        store, base = _filesystem(folder)
        cell = int(part["_cell"].iloc[0])
        names = part["_key"].to_numpy(dtype=object)
        order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or ""))
        rows, made = _rows(part.iloc[order], space, wanted), []
        for start in range(0, len(rows.keys), BLOCK_ROWS):
            data = pickle.dumps(rows.part(slice(start, start + BLOCK_ROWS)).__dict__, protocol=5)
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pa.compress(data, codec="lz4", asbytes=True))
            made.append((cell, name, len(data)))
        return pd.DataFrame(made, columns=["cell", "name", "bytes"])

    tasks = max(1, min(MAX_TASKS, len(boxes.cells), sum(-(-int(n) // 5000) for n in boxes.rows)))
    files = cut.repartition(tasks, "_cell", "_block").groupBy("_cell", "_block").applyInPandas(pack, "cell int, name string, bytes long")
    found: dict[int, list[tuple[str, int]]] = {}
    for r in files.collect():
        found.setdefault(r["cell"], []).append((f"{folder}/{r['name']}", r["bytes"]))
    return {c: sorted(v) for c, v in found.items()}


def _bounding(sample: pd.DataFrame, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The numeric features in which rows differ most, and their medians."""
    numbers, _ = space.arrays(sample)
    widths = np.array([1.0 if space.euclidean else space.ranges.get(name) or np.inf for name in space.numeric], float)
    if not numbers.size:
        return np.arange(min(numbers.shape[1], BOUND_FEATURES)), np.zeros(min(numbers.shape[1], BOUND_FEATURES))
    scaled = numbers / widths
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        middle = np.nan_to_num(np.nanmedian(scaled, axis=0))
        spread = np.nan_to_num(np.nanmean(np.abs(scaled - middle), axis=0)) * (1 - np.isnan(scaled).mean(axis=0))
    chosen = np.argsort(-spread, kind="stable")[:BOUND_FEATURES]
    chosen = chosen[spread[chosen] >= 0.2 * spread[chosen[0]]]
    return chosen, middle[chosen]


def _searched(
    near: DataFrame, asked: dict[int, int], blocks: dict[int, list[tuple[str, int]]], boxes: Boxes, space: Space,
    bounding: tuple[np.ndarray, np.ndarray], k: int, wanted: Sequence[str], by_target: bool,
) -> DataFrame:
    """The k best of every (query, target), the queries of a cell together."""
    parts = {c: -(-n // QUERY_ROWS) for c, n in asked.items()}
    cut = near.withColumn("_block", _part(parts, ["_key"]))
    names = list(wanted) if by_target else [""]
    kept: dict[str, tuple[Donors, int]] = {}

    def donors_of(cell: int) -> Iterator["Donors"]:
        for path, size in blocks.get(cell, ()):
            if path not in kept:
                while kept and sum(s for _, s in kept.values()) + size > KEPT_BYTES:
                    kept.pop(next(iter(kept)))
                store, name = _filesystem(path)
                with store.open_input_stream(name, compression=None) as stream:
                    data = pa.decompress(stream.read(), decompressed_size=size, codec="lz4", asbytes=True)
                kept[path] = Donors(Rows(**pickle.loads(data)), bounding, space), size
            yield kept[path][0]

    def search(part: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(part, space, wanted)
        home, group = int(part["_cell"].iloc[0]), part["_group"].iloc[0]
        results = []
        if by_target and not wanted:
            rows = rows.part(slice(0, 0))
        for at in _alike(rows.codes):
            queries = Search(rows.part(at), bounding, space, k, by_target)
            for cell in queries.cells(home, group, boxes):
                for offered in donors_of(cell):
                    queries.meet(offered)
            results.append(queries.result(names))
        columns = ("_key", "target", "donor", "distance", "value", "rank")
        if not results:
            return pd.DataFrame({c: pd.Series(dtype=object if i < 3 else float) for i, c in enumerate(columns)}).astype({"rank": "int32"})
        return _plain(pd.DataFrame({c: np.concatenate([r[c] for r in results]) for c in columns}))

    schema = "_key string, target string, donor string, distance double, value double, rank int"
    tasks = max(1, min(MAX_TASKS, sum(parts.values())))
    return cut.repartition(tasks, "_cell", "_block").groupBy("_cell", "_block").applyInPandas(search, schema)


def _alike(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of rows in batches: rows with the same texts together, where there are enough of them."""
    order = np.lexsort(codes) if len(codes) else np.arange(codes.shape[1])
    if not len(order):
        return
    sorted_ = codes[:, order]
    starts = np.flatnonzero(np.concatenate(([True], (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0))))
    few: list[np.ndarray] = []
    for start, end in zip(starts, [*starts[1:], len(order)]):
        run = order[start:end]
        if len(run) >= ALIKE:
            for i in range(0, len(run), QUERY_BATCH):
                yield run[i : i + QUERY_BATCH]
            continue
        few.append(run)
        if sum(map(len, few)) >= 4 * ALIKE:
            yield np.concatenate(few)
            few = []
    if few:
        yield np.concatenate(few)


class Donors:
    """Donors of a block with what bounds and comparisons need of them."""

    def __init__(self, rows: Rows, bounding: tuple[np.ndarray, np.ndarray], space: Space):
        self.rows = rows
        self.hashes = pd.util.hash_array(rows.keys)
        self.bound, self.lacks, self.size = _bound_arrays(rows, bounding, space)
        self.holes = ~rows.there.all(axis=0)
        self.holds = ~np.isnan(rows.values)


def _bound_arrays(rows: Rows, bounding: tuple[np.ndarray, np.ndarray], space: Space) -> tuple[np.ndarray, np.ndarray, float]:
    """The bounding features by row, less their medians and 0 where missing; which are missing; the largest size."""
    chosen, middle = bounding
    kind = np.float64 if space.euclidean else np.float32
    there = rows.there[:, chosen]
    found = np.where(there, rows.numbers[:, chosen] - middle, 0.0)
    return found.T.astype(kind), (~there.T).astype(kind), float(np.abs(found).max(initial=0.0))


class Search:
    """Queries searched together and the best donors of each so far."""

    def __init__(self, rows: Rows, bounding: tuple[np.ndarray, np.ndarray], space: Space, k: int, by_target: bool):
        self.rows, self.space, self.k, self.by_target = rows, space, k, by_target
        m = len(rows.keys)
        self.hashes = pd.util.hash_array(rows.keys)
        self.bound, self.lacks, self.size = _bound_arrays(rows, bounding, space)
        self.holes = ~rows.there.all(axis=0)
        self.wants = np.isnan(rows.values) if by_target else np.ones((m, 1), bool)
        self.kth = np.full(self.wants.shape, np.inf)
        self._limits: np.ndarray | None = None
        # Texts that all these queries have in common.
        self.alike = [bool(rows.named[:, j].all() and (c == c[:1]).all()) for j, c in enumerate(rows.codes)]
        self.present = np.maximum(rows.there.sum(axis=1) + rows.named.sum(axis=1), 1).astype(float)
        none = np.empty(0)
        self.best = none.astype(int), none.astype(int), none, none.astype(object), none

    def limits(self) -> np.ndarray:
        """What a pair's sum may come to: of gaps, or of squares."""
        if self._limits is None:
            reach = np.where(self.wants, self.kth, -np.inf).max(axis=1, initial=-np.inf)
            square = np.square(reach * (1 + SLACK)) if self.space.euclidean else (reach + SLACK) * self.present
            self._limits = np.where(reach >= 0, square, -1.0)
        return self._limits

    def cells(self, home: int, group: str, boxes: Boxes) -> Iterator[int]:
        """The queries' own cell, then others from the nearest on, as long as any of them may hold a closer donor."""
        self.open = np.arange(len(self.rows.keys))
        yield home
        others = np.flatnonzero((boxes.groups == group) & (boxes.cells != home))
        if not len(others):
            return
        ready = Ready(self.rows.numbers.T, self.rows.codes, self.rows.there, self.rows.named)
        limit = self.limits().max(initial=-1.0)
        others = others[self._apart(boxes, others) <= limit * (1 + SLACK) + SLACK]
        if not len(others):
            return
        bound = self.space.lower_bounds(ready, boxes.part(others))
        bound = np.square(bound) if self.space.euclidean else bound * self.present[:, None]
        for place in np.argsort(bound.min(axis=0), kind="stable"):
            self.open = np.flatnonzero(bound[:, place] <= self.limits() * (1 + SLACK))
            if len(self.open):
                yield int(boxes.cells[others[place]])

    def _apart(self, boxes: Boxes, cells: np.ndarray) -> np.ndarray:
        """A sum that no pair of any query and a donor of the box can fall below."""
        total = np.zeros(len(cells))
        for place, j in enumerate(boxes.split):
            if not self.holes[j]:
                x = self.rows.numbers[:, j]
                gap = np.maximum(np.maximum(boxes.low[place][cells] - x.max(), x.min() - boxes.high[place][cells]), 0.0)
                gap = np.where(boxes.null[place][cells], 0.0, gap)
                total += gap * gap if self.space.euclidean else gap
        for j, alike in enumerate(self.alike):
            if alike:
                total += (boxes.codes[j][cells] != self.rows.codes[j, 0]) & boxes.single[j][cells]
        return total

    def meet(self, donors: Donors) -> None:
        limits = self.limits()
        rows, limit = self.open, limits[self.open]
        # Texts that all queries share rule out donors, the others pairs.
        shared, own = np.zeros(len(donors.rows.keys)), []
        for j, alike in enumerate(self.alike):
            if alike:
                shared += (donors.rows.codes[j] != self.rows.codes[j, 0]) & donors.rows.named[:, j]
            else:
                own.append(j)
        left = np.flatnonzero(shared <= limit.max(initial=-1.0) * (1 + SLACK))
        # Donors that share fewer texts meet the queries that are still open for so much.
        levels = np.unique(shared[left]) if len(rows) * len(left) > LEVEL_PAIRS else np.zeros(min(1, len(left)))
        for level in levels:
            columns = left[shared[left] == level] if len(levels) > 1 else left
            within = rows[limit * (1 + SLACK) >= level]
            step = max(512, BATCH_PAIRS // max(len(within), 1))
            for start in range(0, len(columns), step):
                self._meet(donors, within, columns[start : start + step], shared, own)

    def _meet(self, donors: Donors, rows: np.ndarray, columns: np.ndarray, shared: np.ndarray, own: list[int]) -> None:
        kind = self.bound.dtype
        low = np.empty((len(rows), len(columns)), kind)
        low[:] = shared[columns]
        lefts, rights, gap = self.bound[:, rows], donors.bound[:, columns], np.empty_like(low)
        for left, right in zip(lefts, rights):
            np.subtract(left[:, None], right[None, :], out=gap)
            np.square(gap, out=gap) if self.space.euclidean else np.abs(gap, out=gap)
            low += gap
        # What pairs with a missing value have added is known from each row alone.
        if self.lacks.any():
            low -= self.lacks[:, rows].T @ np.abs(rights)
        if donors.lacks.any():
            low -= np.abs(lefts).T @ donors.lacks[:, columns]
        for j in own:
            unequal = self.rows.codes[j][rows, None] != donors.rows.codes[j][None, columns]
            low += unequal & self.rows.named[rows, j][:, None] & donors.rows.named[columns, j][None, :]
        if self.space.euclidean:
            slack = 1e-12 * (1 + low.max(initial=0.0))
        else:
            slack = 1e-6 * (10 + len(self.bound) * (self.size + donors.size))  # of single precision
        limits = self.limits()[rows]
        seeds = 8 * self.k
        if low.shape[1] > seeds and np.isinf(limits).any():
            # The likely best come first, so that they rule out others; no limit lets a NaN pass.
            first = np.argpartition(low, seeds - 1, axis=1)[:, :seeds]
            at = np.repeat(np.arange(len(rows)), seeds)
            self._compare(donors, rows[at], columns[first.ravel()])
            low[at, first.ravel()] = np.nan
            limits = self.limits()[rows]
        limits = (limits * (1 + 1e-6) + slack).astype(kind)
        one, two = np.divmod(np.flatnonzero(low <= limits[:, None]), low.shape[1])
        self._compare(donors, rows[one], columns[two])

    def _compare(self, donors: Donors, i: np.ndarray, j: np.ndarray) -> None:
        """Distances of these pairs in full, and the best of them kept."""
        same = np.flatnonzero(self.hashes[i] == donors.hashes[j])
        same = same[self.rows.keys[i[same]] == donors.rows.keys[j[same]]]
        if len(same):
            i, j = np.delete(i, same), np.delete(j, same)
        made = []
        for start in range(0, len(i), FULL_PAIRS):
            a, b = i[start : start + FULL_PAIRS], j[start : start + FULL_PAIRS]
            far = self._distances(donors, a, b)
            pair, target = np.nonzero(self.wants[a] & (donors.holds[b] if self.by_target else True) & (far[:, None] <= self.kth[a]))
            made.append((a[pair], target, far[pair], b[pair]))
        if not made:
            return
        query, target, far, donor = (np.concatenate(x) for x in zip(*made))
        if not len(query):
            return
        values = donors.rows.values[donor, target] if self.by_target else np.full(len(donor), np.nan)
        # No more than the k first of a block, equal ones in donor order, meet those found before.
        order = np.lexsort((donor, far, target, query))
        order = order[_turns(query[order], target[order]) < self.k]
        new = query[order], target[order], far[order], donors.rows.keys[donor[order]], values[order]
        touched = np.zeros(len(self.rows.keys), bool)
        touched[new[0]] = True
        old = touched[self.best[0]]
        query, target, far, names, values = (np.concatenate((x[old], y)) for x, y in zip(self.best, new))
        order = np.lexsort((far, target, query))
        q, t, d = query[order], target[order], far[order]
        equal = np.flatnonzero((q[1:] == q[:-1]) & (t[1:] == t[:-1]) & (d[1:] == d[:-1]))
        if len(equal):
            tied = np.unique(order[np.concatenate((equal, equal + 1))])
            by_name = np.zeros(len(names), int)
            by_name[tied] = np.unique(["" if x is None else x for x in names[tied]], return_inverse=True)[1]
            order = np.lexsort((by_name, far, target, query))
        place = _turns(query[order], target[order])
        last = order[place == self.k - 1]
        self.kth[query[last], target[last]] = far[last]
        self._limits = None
        order = order[place < self.k]
        self.best = tuple(np.concatenate((x[~old], y[order])) for x, y in zip(self.best, (query, target, far, names, values)))

    def _distances(self, donors: Donors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        left, right = self.rows, donors.rows
        if self.space.euclidean:
            total = np.zeros(len(i))
            for f in range(left.numbers.shape[1]):
                total += np.square(left.numbers[i, f] - right.numbers[j, f])
            return np.sqrt(total)
        gap = np.abs(left.numbers[i] - right.numbers[j])
        known = np.full(len(i), float(left.numbers.shape[1]))
        if self.holes.any() or donors.holes.any():
            both = left.there[i] & right.there[j]
            gap *= both
            known = both.sum(axis=1).astype(float)
        total = gap.sum(axis=1)
        for f, (one, two) in enumerate(zip(left.codes, right.codes)):
            both = left.named[i, f] & right.named[j, f]
            total += (one[i] != two[j]) & both
            known += both
        # Equal distances stay equal in whatever order they were summed.
        found = np.round(total / np.maximum(known, 1.0), DIGITS)
        found[known == 0] = 1.0
        return found

    def result(self, names: list[str]) -> dict[str, np.ndarray]:
        query, target, far, donor, values = self.best
        order = np.arange(len(query))
        rank = np.empty(len(query), "int32")
        place = np.lexsort((order, target, query))
        rank[place] = _turns(query[place], target[place]) + 1
        return {
            "_key": self.rows.keys[query], "target": np.array(names, dtype=object)[target], "donor": donor, "distance": far,
            "value": values, "rank": rank,
        }


def _turns(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Places within runs of one query and target."""
    if not len(query):
        return np.empty(0, int)
    first = np.flatnonzero(np.concatenate(([True], (query[1:] != query[:-1]) | (target[1:] != target[:-1]))))
    return np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate((first, [len(query)]))))


def _batches(rows: pd.DataFrame, others: int) -> Iterator[tuple[int, pd.DataFrame]]:
    size = max(1, BATCH_PAIRS // max(others, 1))
    for start in range(0, len(rows), size):
        yield start, rows.iloc[start : start + size]


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Text columns as plain objects, which can be handed back whatever they were cut from."""
    texts = [c for c in rows.columns if not pd.api.types.is_numeric_dtype(rows[c])]
    return rows.astype({c: object for c in texts})
