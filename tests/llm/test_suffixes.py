import hashlib
import random

import numpy as np
import pytest

from fathom.llm import suffixes
from fathom.llm.suffixes import common_prefixes, repeated_windows, suffix_array, without_repeats

from .conftest import words


def brute(rows, length=100):
    """(doc_id, bytes, removed, spans, digest) for each row, window by window."""
    first = {}
    encoded = {(i is None, i or 0, (t or "").encode()) for i, t in rows}
    order = sorted(encoded, key=lambda r: (r[0], r[1], int(hashlib.md5(r[2]).hexdigest()[:15], 16)))
    marks = {}
    for text in order:
        data = text[2]
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first.setdefault(data[k : k + length], (text, k)) != (text, k):
                gone[k : k + length] = b"\1" * length
        marks[text] = gone
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = marks[i is None, i or 0, data]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def results(df):
    return sorted(map(tuple, without_repeats(df).collect()), key=str)


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(3)
    for n, letters in ((1, 2), (9, 1), (200, 1), (300, 2), (700, 3)):
        data = draw.integers(97, 97 + letters, n, dtype=np.uint8)
        data = np.concatenate((data, data[n // 3 :]))
        raw = data.tobytes()
        order, place = suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
        assert (place[order] == np.arange(len(raw))).all()
        shared = common_prefixes(data, order, place, 100, lanes=7)
        for a, b in zip(order[:-1], order[1:]):
            most = min(100, len(raw) - max(a, b))
            want = next((k for k in range(most) if raw[a + k] != raw[b + k]), most)
            assert min(shared[b], most) == want


def test_windows_of_texts():
    texts = [b"abcdef", b"xbcdey", b"bcd"]
    flags = repeated_windows(texts, np.array([4, 4, 1]), np.array([0, 1 << 32, 2 << 32]), 3)
    assert flags.tolist() == [False, False, False, False, False, True, True, False, True]


def corpus():
    draw, passage = random.Random(6), words(50, 40)
    rows = [(k, words(100 + k, draw.randint(1, 80))) for k in range(60)]
    rows += [(100 + k, f"{words(200 + k, 15)} {passage[k % 9 :]} {words(300 + k, 12)}") for k in range(40)]
    rows += [(200 + k, rows[3][1] + rows[4][1]) for k in range(3)] + [(300, "é" * 120), (299, "é" * 90), (301, "ab" * 300)]
    rows += [(400, "word " * 200), (401, "word " * 60 + "x" + "word " * 60), (402, passage[:99]), (403, passage[:100])]
    base = words(60, 120).split()
    for k in range(30):
        w = list(base)
        w[draw.randrange(120)] = "changed"
        rows.append((500 + k, " ".join(w)))
    draw.shuffle(rows)
    return rows


def test_removed_bytes_equal_brute_force(make):
    rows = corpus()
    assert results(make(rows)) == brute(rows)
    assert results(make(rows).repartition(9)) == brute(rows)


def test_small_shards_and_pieces(make, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 3000)
    rows = corpus()
    assert results(make(rows).coalesce(1)) == brute(rows)


def test_shard_parts_of_one_task(monkeypatch):
    rows = [(k, f"{words(k % 7, 60)} {words(50 + k, 20)}") for k in range(40)]
    monkeypatch.setattr(suffixes, "_PART", 500)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for _, t in rows])
    cut = suffixes._runs(data, offsets, 100)
    monkeypatch.setattr(suffixes, "_PART", 1 << 23)
    whole = suffixes._runs(data, offsets, 100)
    windows = [sorted((f + k, a) for f, n, a in zip(r["first"].tolist(), r["count"].tolist(), r["anchor"].tolist()) for k in range(n)) for r in (cut, whole)]
    assert windows[0] == windows[1]
    assert len(windows[0]) == sum(max(0, len(t) - 99) for _, t in rows)


def test_odd_rows(odd, empty, odd_rows):
    rows = [(i, t) for i, t, *_ in odd_rows]
    assert results(odd) == brute(rows)
    assert without_repeats(empty).count() == 0
    named = suffixes.repeated_stretches(odd.withColumnRenamed("lang", "BEGINS").withColumnRenamed("source", "text_mark"))
    assert named.columns == ["doc_id", "text", "text_mark", "n_chars", "begins", "ends"]


@pytest.mark.parametrize("length", [40, 130])
def test_other_lengths(make, length):
    rows = corpus()[:70]
    got = sorted(map(tuple, without_repeats(make(rows), length=length).collect()), key=str)
    assert got == brute(rows, length)
