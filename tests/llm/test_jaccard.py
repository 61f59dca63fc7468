import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import jaccard
from fathom.llm.batches import add_columns
from fathom.llm.jaccard import Bounds, jaccard_components, signatures
from fathom.session import ARROW_BYTES

from .conftest import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, length=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1)))


def brute(rows, percent=90, length=3):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), by all pairs."""
    sets = [shingles(t, length) for _, t in rows]
    own = list(range(len(rows)))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            own[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least.setdefault(root(k), []).append(doc_id)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return sorted(((i, len(s), smallest[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(text, draw, edits):
    w = text.split()
    for _ in range(edits):
        at, what = draw.randrange(len(w)), draw.random()
        w[at : at + 1] = [] if what < 0.3 else [w[at], f"n{draw.randrange(10**6)}"] if what < 0.6 else [f"n{draw.randrange(10**6)}"]
    return " ".join(w)


def families(seed, groups, members, size, most):
    draw, rows = random.Random(seed), []
    for g in range(groups):
        base = words(seed * 1000 + g, draw.choice(size))
        rows += [edited(base, draw, draw.randrange(most + 1)) for _ in range(members)]
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(
    "rows",
    [
        families(1, 30, 6, [12, 25, 40, 120, 300], 3),
        families(2, 2, 60, [200], 14),  # frequent tokens: combinations; sets on both sides of the limit
        families(3, 1, 80, [60], 4),
    ],
    ids=["small families", "large families", "short texts"],
)
@pytest.mark.parametrize("rare", [1, 16])
def test_components_equal_brute_force(spark, monkeypatch, rows, rare):
    monkeypatch.setattr(jaccard, "RARE", rare)
    passage = words(99, 60)
    rows = rows + [(1000 + k, passage + " " + words(300 + k, 4 + 3 * k)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard_components(docs)) == brute(rows)


@pytest.mark.parametrize("percent, length", [(100, 3), (80, 2), (60, 1)])
def test_other_limits(spark, percent, length):
    rows = families(4, 8, 10, [3, 5, 9, 30, 80], 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(docs, percent=percent, length=length)) == brute(rows, percent, length)


def test_odd_rows(spark, odd_rows, odd, empty):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert got(jaccard_components(odd)) == brute(rows)
    result = jaccard_components(empty)
    assert result.collect() == []
    assert result.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]


def test_clashing_columns_and_repeated_numbers(spark):
    rows = [(7, "A b c d"), (7, "a B c D"), (7, "other words here"), (3, "a b c d"), (7, "two words"), (5, "Two\twords"), (None, "lone")]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, node int, key string, band double")
    assert got(jaccard_components(docs)) == brute(rows)


def test_chains_and_limit_cases(spark):
    # 20 shingles; 19 in common of 21 is linked (90.5 per cent), 18 of 22 is not; links form a chain.
    base = words(5, 22).split()
    rows = [(k, " ".join(base[k:] + words(60 + k, 22).split()[:k])) for k in range(6)]
    # 9 shingles inside 10 are linked, 8 inside 9 are not.
    other = words(8, 40).split()
    rows += [(20, " ".join(other[:11])), (21, " ".join(other[:12])), (22, " ".join(other[20:30])), (23, " ".join(other[20:31]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(docs)) == brute(rows)


def test_large_blocks(spark, monkeypatch):
    from fathom.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    rows = families(6, 3, 50, [150], 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(docs)) == brute(rows)


@pytest.mark.parametrize("percent", [51, 70, 90, 99])
def test_linked_sets_share_a_signature(percent):
    draw, bounds = np.random.default_rng(percent), Bounds(percent)
    pool = draw.integers(1, 1 << 63, 4000, dtype=np.uint64)
    for _ in range(300):
        n = int(draw.integers(2, 700))
        one = draw.choice(pool, n, replace=False)
        lost = int(draw.integers(0, bounds.errors(n) + 1))
        two = one[lost:]
        frequency = dict(zip(pool.tolist(), draw.choice([2, 10, 17, 900], len(pool)).tolist()))
        found = []
        for s in (one, two):
            band = np.sort(s)[: bounds.band(len(s))]
            found.append(signatures(band, np.array([frequency[x] for x in band.tolist()]), len(s), bounds))
        assert np.intersect1d(*found).size > 0


def test_signatures_stay_in_proportion():
    bounds = Bounds(90)
    for n in (100, 1000, 10_000, 100_000):
        tokens = np.sort(np.random.default_rng(n).integers(1, 1 << 63, bounds.band(n), dtype=np.uint64))
        found = signatures(tokens, np.full(len(tokens), 1000), n, bounds)
        assert len(found) <= 4 * n


def test_bounds_hold_for_all_sizes():
    for percent in (51, 60, 80, 90, 99, 100):
        b = Bounds(percent)
        assert all(b.extension(n) <= b.extension(n + 1) and b.band(n) <= n for n in range(1, 5000))
        for n in range(1, 3000):
            sizes = range(b.overlap(n), 100 * n // percent + 1)
            assert all(set(b.levels(n)) & set(b.levels(m)) for m in (sizes[0], sizes[-1]))
            for level in b.levels(n):
                assert b.shared(n) >= b.classes(level) + 1 or b.classes(level) == 0


def test_tasks_are_handed_small_batches(spark):
    """op13: a batch is held several times over by a task, so its bytes are bounded, not only its rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, expected in (("64m", ARROW_BYTES), ("1m", 1 << 20)):
            spark.conf.set(name, given)
            docs = spark.range(600).repartition(1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 4000) AS text")
            add_columns(docs, "n long", lambda batch: [pa.array([0] * batch.num_rows, pa.int64())])
            assert spark.conf.get(name) == f"{expected}b"
            sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
            assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] <= 1.2 * ARROW_BYTES
    finally:
        spark.conf.set(name, before)
