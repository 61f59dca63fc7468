import re
from collections import defaultdict

import numpy as np

from fathom.llm.batches import text_bytes
from fathom.llm.lines import drop_recurring_lines, parsed_lines, recurring_lines

from .conftest import words


def brute(rows, min_texts=5):
    """Lines to drop per row, by the rules in words: one template per leaf from majorities, the rest exact."""
    order = {}
    for i, t in rows:
        k = (i is None, i or 0)
        order[t or ""] = min(order.get(t or "", k), k)
    parsed = {
        t: [(n, tuple("*" if re.search(r"[0-9@]|://", w) else w for w in line.split())) for n, line in enumerate(t.split("\n")) if line.split()]
        for t in order
    }
    leaves = defaultdict(lambda: defaultdict(int))
    for lines in parsed.values():
        for _, w in lines:
            leaves[len(w), w[:3]][w] += 1
    template = {}
    for leaf, lines in leaves.items():
        if sum(lines.values()) < min_texts or len(lines) < 2:
            continue
        fixed = {}
        for place in range(leaf[0]):
            votes = defaultdict(int)
            for w, n in lines.items():
                votes[w[place]] += n
            best = max(votes.values())
            if 2 * best > sum(votes.values()):
                fixed[place] = max(votes, key=votes.get)
        for w in lines:
            if sum(fixed.get(k) == x for k, x in enumerate(w)) >= 0.8 * len(w) - 1e-9:
                template[w] = leaf
    holders = defaultdict(set)
    for t, lines in parsed.items():
        for _, w in lines:
            holders[template.get(w, w)].add(t)
    recurring = {k: min(v, key=lambda t: order[t]) for k, v in holders.items() if len(v) >= min_texts}
    return {
        t: [n for n, w in lines if template.get(w, w) in recurring and recurring[template.get(w, w)] != t] for t, lines in parsed.items()
    }


def corpus():
    rows = []
    for k in range(40):
        lines = [words(1000 + 10 * k + j, 12) for j in range(4)]
        lines.insert(k % 4, "All rights are reserved here.")
        lines.insert(1, f"Posted on {k}.0{k % 9}.2024 by user{k} in section news of today")
        if k % 2:
            lines.append(f"Read the whole story of {words(k, 1)} on the pages of our morning paper")
        if k % 10 == 0:
            lines.append("only four texts have this line")
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, rows[3][1]) for k in range(20)]
    return rows


def test_dropped_lines_equal_brute_force(make):
    rows = corpus()
    want = brute(rows)
    got = recurring_lines(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.dropped or []) == want[r.text]
    assert not next(r.dropped for r in got if r.doc_id == 0)
    assert sum(len(r.dropped or []) for r in got) > 100


def test_long_line_of_two_texts(make):
    passage, other = words(70, 60), words(71, 60)
    rows = [(k, f"{words(800 + k, 30)}\n{words(900 + k, 30)}") for k in range(6)]
    for k in (2, 4):
        rows[k] = (k, f"{rows[k][1]}\n{passage}\nnot a long line")
    rows += [(10, f"{other} 1.1.2024\n{words(810, 30)}"), (11, f"{words(811, 30)}\n{other} 2.1.2024"), (11, rows[1][1])]
    # A template of few texts does not hide an equal line in it.
    near = passage.split()
    near[30] = "changed"
    rows.append((12, f"{words(812, 30)}\n{' '.join(near)}"))
    rows += [(20 + k, f"{words(820 + k, 30)}\n{passage.split()[0]} {passage.split()[1]} {passage.split()[2]} {words(830 + k, 57)}") for k in range(3)]
    got = {(r.doc_id, r.text): r.dropped for r in recurring_lines(make(rows)).collect()}
    assert {k: v for k, v in got.items() if v} == {rows[4]: [2], (11, rows[7][1]): [1]}


def test_lines_are_parsed():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["a 1\n\nb c d\n", "", "\n\n", "b c d", None, "x\ty z\r\n a"]))
    _, rows, numbers, low, high, leaf, line = parsed_lines(data, offsets, 3)
    assert list(zip(rows.tolist(), numbers.tolist(), (high - low).tolist())) == [(0, 0, 2), (0, 2, 3), (3, 0, 3), (5, 0, 3), (5, 1, 1)]
    assert line[1] == line[2] and leaf[1] == leaf[2] and len(np.unique(line)) == 4


def test_odd_rows(odd, empty, odd_rows):
    named = odd.withColumnRenamed("lang", "DROPPED").withColumnRenamed("source", "text_key")
    got = recurring_lines(named, min_texts=1)
    assert got.columns == ["doc_id", "text", "text_key", "n_chars", "dropped"]
    assert all(not r.dropped for r in got.collect())
    assert recurring_lines(empty).count() == 0
    same = drop_recurring_lines(odd, min_texts=2)
    assert same.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in same.collect()) == sorted((i or 0, t or "") for i, t, *_ in odd_rows)
