import random

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import words
from fathom.llm.batches import list_array, pieces, text_bytes
from fathom.llm.words import FOLDED, PLAIN, find_words, row_shingles, sequence_hashes

TEXTS = ["", "one", " two  three\t", None, "x\x0by\x0cz\r\n1", "é ü\u00a0w", "\x85 \x1c", "a" * 500 + " b", "one two three " * 90]


@pytest.mark.parametrize("part", [1, 7, 100, 1 << 21])
def test_words_are_those_of_white_space(monkeypatch, part):
    monkeypatch.setattr(words, "_PART", part)
    data, offsets = text_bytes(pa.array(TEXTS))
    found = find_words(data, offsets)
    known = {}
    for k, text in enumerate(TEXTS):
        a, b = found.bounds[k], found.bounds[k + 1]
        mine = [bytes(data[x:y]) for x, y in zip(found.starts[a:b], found.ends[a:b])]
        assert mine == (text or "").encode().split()
        for word, value in zip(mine, found.hashes[a:b].tolist()):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_folded_words():
    data, offsets = text_bytes(pa.array(["It's ONE-two, É3!", "it s one two É3"]))
    found = find_words(data, offsets, FOLDED)
    a, b, c = found.bounds
    assert found.hashes[a:b].tolist() == found.hashes[b:c].tolist() and b - a == 5
    assert len(find_words(data, offsets, PLAIN).hashes) == 8


def test_sequences():
    hashes = np.arange(1, 10, dtype=np.uint64)
    assert len(sequence_hashes(hashes, 5)) == 5 and len(sequence_hashes(hashes[:3], 5)) == 0
    assert len(row_shingles(hashes[:3], 5)) == 1 and len(row_shingles(hashes[:0], 5)) == 0
    assert sequence_hashes(hashes, 3)[4] == sequence_hashes(hashes[4:7], 3)[0]
    assert sequence_hashes(hashes, 2)[0] != sequence_hashes(hashes[[1, 0]], 2)[0]


def test_pieces_hold_whole_rows():
    draw = random.Random(3)
    texts = ["".join(draw.choices("abé ", k=draw.randint(0, 60))) for _ in range(200)]
    column = pa.array([None, *texts])[1:]
    for size in (1, 50, 10_000):
        seen = []
        for start, data, offsets in pieces(column, size):
            assert start == len(seen) and (len(data) <= size or len(offsets) == 2)
            seen += [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])]
        assert seen == texts
    assert list(pieces(pa.array([], pa.string()))) == []
    assert list_array(np.arange(3), np.array([1, 0, 2]), pa.int64()).to_pylist() == [[0], [], [1, 2]]
