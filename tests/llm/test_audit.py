import random
import re
from itertools import permutations

import numpy as np

from fathom.llm import audit as module
from fathom.llm.audit import audit, failed_by_text, failures, measure

from .conftest import SCHEMA, words

LABELS = "doc_id long, quality int, toxic int"


def brute_failures(rows):
    """The failed filters of each (doc_id, text, source), as a set of letters."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        if len(w) < 50:
            failed.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            failed.add("C")
        if re.search(r"[#$%&*|]", t):
            failed.add("D")
        others = [i for i, x, _ in rows if (x or "") == t and i is not None]
        if any(doc_id is None or i < doc_id for i in others):
            failed.add("E")
        out.append(failed)
    return out


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed, out = brute_failures(rows), {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, failed) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for _, f in own:
                first = next((x for x in order if x in f), None)
                if first:
                    shapley[first] += 1
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [i for i, f in own if name in f and not f & before]
                out[part, "".join(order), step] = (
                    sum(1 for _, f in own if not f & (before | {name})),
                    len(removed),
                    sum(1 for _, f in own if name in f and f & before),
                    sum(1 for _, f in own if f == {name}),
                    sum(i in good for i in removed),
                    sum(i in toxic for i in removed),
                    shapley[name],
                )
    return out


def check(spark, rows, labels, schema=SCHEMA):
    got = audit(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, LABELS)).collect()
    short = [(r[0], r[1], r[3]) for r in rows]
    want = brute_audit(short, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want
    assert len(got) == len(want)


def test_odd_rows_equal_brute_force(spark, odd_rows):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1)]
    check(spark, odd_rows, labels)


def test_texts_that_fail_in_all_ways(spark):
    draw, rows = random.Random(4), []
    for k in range(120):
        w = words(k % 40, draw.choice([10, 50, 90])).split()
        if draw.random() < 0.4:
            w = w[:9] * 9
        if draw.random() < 0.4:
            w = [x.upper() if draw.random() < 0.3 else x for x in w]
        if draw.random() < 0.4:
            w[3] += draw.choice("#$%&*|")
        rows.append((k, draw.choice([" ", "\t", " \n "]).join(w), "en", draw.choice(["a", "b", "ü", None]), 0))
    check(spark, rows, [(k, k % 2, int(k % 3 == 0)) for k in range(0, 120, 2)])


def test_one_pass_counts_what_patterns_count():
    texts = ["", " ", "a", "Ab ab Ab", "é É\tÉ\x0bé", "x" * 70_000 + " " + "x" * 70_000, "#$ &   A\x85B", "a b a c", " lead", "trail "]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    got = measure(data, np.cumsum([0, *map(len, raw)]))
    w = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert got["words"].tolist() == [len(x) for x in w]
    assert got["distinct"].tolist() == [len(set(x)) for x in w]
    assert got["code_points"].tolist() == [len(t) for t in texts]
    assert got["capitals"].tolist() == [len(re.findall("[A-Z]", t)) for t in texts]
    assert got["symbols"].tolist() == [len(re.findall(r"[#$%&*|]", t)) for t in texts]


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(module, "span_hashes", lambda data, values, starts, ends: np.zeros(len(starts), np.uint64))
    text = " ".join(["ab", "cd", "ab", "ef", "abc", "cd", "gh"])
    data = np.frombuffer(text.encode(), np.uint8)
    assert measure(data, np.array([0, len(data)]))["distinct"].tolist() == [5]


def test_limits_are_exact():
    w = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]
    texts = [" ".join(w[:49]), " ".join(w[:50]), " ".join(w[:65] + w[:35]), " ".join(w[:64] + w[:36]), "A" + "b" * 19, "A" * 2 + "b" * 37]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    assert failed_by_text(measure(data, np.cumsum([0, *map(len, raw)]))).tolist() == [1, 0, 0, 2, 1, 5]


def test_empty_tables_and_clashing_columns(spark, empty):
    none = spark.createDataFrame([], LABELS)
    assert audit(empty, none).collect() == []
    clashing = spark.createDataFrame(
        [(1, "a b", "s", "x", 7, 1, 2.0), (2, "a b", "s", "y", 8, 1, 2.0)],
        "doc_id long, text string, source string, part string, failed int, good int, n double",
    )
    got = audit(clashing, none)
    assert got.count() == 600
    assert {r.failed for r in failures(clashing).collect()} == {1, 17}


def test_parts_may_be_numbers(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", None)], "doc_id long, text string, kind int")
    assert {r.part for r in audit(df, spark.createDataFrame([], LABELS), part="kind").collect()} == {"", "3"}
