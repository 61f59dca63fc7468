import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from fathom.llm.mixing import _permuted, filled_targets, mix, sainte_lague, taken_words

from .conftest import words


def dealt(weights, caps, seats):
    given = [0] * len(weights)
    for _ in range(seats):
        best, at = 0.0, -1
        for k, w in enumerate(weights):
            if given[k] < caps[k] and w / (2 * given[k] + 1) > best:
                best, at = w / (2 * given[k] + 1), k
        if at < 0:
            break
        given[at] += 1
    return given


def test_apportionment_equals_dealing_one_by_one():
    draw = random.Random(1)
    for turn in range(400):
        n = draw.randint(1, 12)
        weights = [draw.choice([0, 1, 2, 5, 7.5, 100, draw.random()]) for _ in range(n)]
        caps = [draw.choice([0, 1, 3, 40, 1000]) for _ in range(n)]
        seats = draw.randint(0, 300)
        assert sainte_lague(weights, caps, seats).tolist() == dealt(weights, caps, seats), (weights, caps, seats)


def test_targets_share_the_excess():
    assert filled_targets([5, 2, 1], [100, 100, 100], 450, 2).tolist() == [200.0, 2 * 250 / 3, 250 / 3]
    assert filled_targets([5, 2], [1, 0], 10, 2).tolist() == [2.0, 0.0]
    assert filled_targets([], [], 0, 2).tolist() == []


def test_blocks_are_permuted():
    for count in (1, 2, 3, 12, 97, 360, 1024):
        for seed in (0, 5, 123456789012345, -7):
            blocks = np.arange(count)
            seeds = np.full(count, seed, np.int64)
            assert sorted(_permuted(blocks, np.full(count, count), seeds).tolist()) == list(range(count))


def test_words_of_a_shard_add_up():
    size = np.array([3, 0, 50, 8, 1, 17])
    begin = np.cumsum(size) - size
    total = np.full(6, size.sum())
    for quota in range(0, 2 * math.ceil(size.sum() / 8) + 1):
        taken = taken_words(begin, size, total, np.full(6, quota), np.full(6, 99, np.int64), 8)
        assert (taken <= 2 * size).all() and quota * 8 - 16 < taken.sum() <= quota * 8


def target_of(sizes, share=1.5, repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        parts = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = [s for s in open_ if parts[s] > repeats * sizes[s]]
        if not above:
            return fixed | parts
        fixed |= {s: repeats * sizes[s] for s in above}


def test_mix_meets_its_targets(make):
    draw = random.Random(8)
    rows = [(k, words(k, draw.randint(1, 90)), draw.choice(["a", "a", "a", "b", "ü", "z", None])) for k in range(900)]
    rows += [(5000, words(1, 3000), "b"), (5001, None, "b"), (5002, " \t", "none")]
    docs = make(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    per_source, taken = defaultdict(int), defaultdict(int)
    for i, _, s in rows:
        per_source[s] += size[i]
    want = target_of(dict(per_source))
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == per_source[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(16, 0.02 * target)
    again = mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_odd_rows(odd, empty, odd_rows):
    got = mix(odd.withColumnRenamed("lang", "taken").withColumnRenamed("n_chars", "size"))
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and got.count() == len(odd_rows)
    assert mix(empty).count() == 0
    assert {r.taken for r in mix(odd.where("doc_id IN (3, 4, 5)")).collect()} == {0}
