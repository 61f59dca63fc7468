import random
from itertools import combinations

import numpy as np
import pytest

from fathom.llm import blocks, minhash
from fathom.llm.minhash import aligned, keep_first, labelled, near_duplicates
from fathom.llm.store import components
from fathom.llm.words import find_words, occurrence_labels, row_shingles

from .conftest import words


def shingles(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return labelled(row_shingles(find_words(data, np.array([0, len(data)])).hashes, 5))


def lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def edited(text: str, seed: int, edits: int) -> str:
    draw, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


def test_alignment_is_the_longest_common_subsequence():
    base = words(5, 120)
    for k in range(12):
        one, two = shingles(base), shingles(edited(base, k, k))
        common = lcs(one.tolist(), two.tolist())
        want = common / (len(one) + len(two) - common)
        assert aligned(one, two, 0.8) == pytest.approx(want if want >= 0.8 else 0.0)


def test_alignment_minds_order():
    w = words(6, 200).split()
    same, moved = " ".join(w), " ".join(w[100:] + w[:100])
    assert aligned(shingles(same), shingles(same), 0.8) == 1.0
    assert aligned(shingles(same), shingles(moved), 0.8) == 0.0


def test_occurrence_labels_number_equal_values():
    assert occurrence_labels(np.array([5, 3, 5, 5, 3], np.uint64)).tolist() == [0, 0, 1, 2, 1]


def test_classes_equal_brute_force(make):
    rows = []
    for g in range(12):
        base = words(100 + g, 80 + 10 * g)
        rows += [(10 * g + k, edited(base, 31 * g + k, k % 4)) for k in range(8)]
    rows += [(1000 + k, words(900 + k, 50)) for k in range(40)]
    passage = words(77, 30)
    rows += [(2000 + k, passage + " " + words(500 + k, 30)) for k in range(60)]
    linked = {i: {i} for i, _ in rows}
    known = {i: shingles(t) for i, t in rows}
    for a, b in combinations(known, 2):
        if aligned(known[a], known[b], 0.8) > 0 and linked[a] is not linked[b]:
            linked[a] |= linked[b]
            for x in linked[b]:
                linked[x] = linked[a]
    got = {r.doc_id: r.class_id for r in near_duplicates(make(rows)).collect()}
    assert got == {i: min(c) for i, c in linked.items()}


def brute_classes(rows):
    known = {i: shingles(t) for i, t in rows}
    linked = {i: {i} for i in known}
    for a, b in combinations(known, 2):
        if linked[a] is not linked[b] and aligned(known[a], known[b], 0.8) > 0:
            linked[a] |= linked[b]
            for x in linked[b]:
                linked[x] = linked[a]
    return {i: min(c) for i, c in linked.items()}


def family(texts: int):
    """One template, most texts 0.45 to 0.75 to each other; every tenth has a copy at 0.8 or more, some of these a further one."""
    base, rows = words(41, 150), []
    for k in range(texts):
        own = edited(base, k, 3 + k % 4)
        rows.append((10 * k, own))
        if k % 10 == 0:
            rows.append((10 * k + 1, edited(own, 9000 + k, 2)))
            rows.append((10 * k + 2, edited(rows[-1][1], 19000 + k, 2)))
    return rows


def test_family_at_the_threshold_equals_brute_force(make):
    rows = family(1000)
    got = {r.doc_id: r.class_id for r in near_duplicates(make(rows)).collect()}
    assert got == brute_classes(rows)


def test_small_blocks_lose_no_link_and_no_pair_is_aligned_twice(make, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    seen, scored = [], minhash._scored

    def counted(pairs, *rest):
        seen.extend(frozenset((bytes(r.key), bytes(r.leader))) for r in pairs.collect())
        return scored(pairs, *rest)

    monkeypatch.setattr(minhash, "_scored", counted)
    rows = family(100)
    got = {r.doc_id: r.class_id for r in near_duplicates(make(rows)).collect()}
    assert got == brute_classes(rows)
    assert len(seen) == len(set(seen)) and all(len(p) == 2 for p in seen)


def test_hot_group_of_near_copies(make):
    base = words(3, 100)
    rows = [(k, edited(base, k, 1)) for k in range(300)] + [(1000 + k, base) for k in range(300)]
    got = near_duplicates(make(rows)).collect()
    assert len(got) == 600 and {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_odd_rows(odd, empty, odd_rows):
    got = near_duplicates(odd.withColumnRenamed("lang", "class_id"))
    rows = got.collect()
    assert got.columns == ["doc_id", "key", "class_id", "kept"] and len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.class_id)
    assert by[1] == [1] and by[2] == [1, 1] and by[3] == [3] and by[4] == [3] and by[5] == [5] and by[None] == [None]
    assert near_duplicates(empty).count() == 0
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        {(i or 0, t or "") for i, t, *_ in odd_rows if i not in (2, 4)}
    )


def test_components(make):
    edges = make([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (2, 1), (20, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 20: 1, 8: 8, 9: 8}
    path = make([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.root for r in components(path).collect()} == {0}
    assert components(make([], "a long, b long")).count() == 0
