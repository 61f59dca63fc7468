"""Words of many texts at once: positions, 64-bit hashes and hashes of word sequences, in numpy.

A word is hashed as a polynomial over random values of its bytes; sums of a running total give all
words of a piece without a loop. Hashes are the same on every machine and in every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SEED = 20240229
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _folded_table() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256)
    letters = (codes >= 97) & (codes <= 122) | (codes >= 65) & (codes <= 90)
    kept = letters | (codes >= 48) & (codes <= 57) | (codes >= 128)
    fold = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return ~kept, _VALUES[fold]


#: The separators and the byte values of words between ASCII white space.
PLAIN = (_space_table(), _VALUES)
#: Those of words of letters and digits, ASCII letters in lower case.
FOLDED = _folded_table()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 bits."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of a piece in order: first byte, end, hash, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


#: Bytes whose words are hashed together; a longer run without a gap is hashed as a whole.
_PART = 1 << 21


def span_hashes(data: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of every word, by parts of the text that end behind a word."""
    found, low = [np.empty(0, np.uint64)], 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _PART, side="right")))
        begin, size = starts[low], ends[high - 1] - starts[low]
        power, inverse = _power_tables(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[begin : begin + size]] * power[:size], out=total[1:])
        first, last = starts[low:high] - begin, ends[low:high] - begin
        found.append(mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)))
        low = high
    return np.concatenate(found)


def find_words(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray] = PLAIN) -> Words:
    """All words of the rows that ``offsets`` cuts ``data`` into; no word crosses rows."""
    separators, values = kind
    n = len(data)
    gap = separators[data]
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = ~gap[edges]
    last[edges - 1] = ~gap[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(starts, ends, span_hashes(data, values, starts, ends), np.searchsorted(starts, offsets))


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from each word on; the last ``length - 1`` words have none."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * np.uint64(_BASE) + hashes[k : k + n]
    return mix(total)


def row_shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words of one text; a shorter text is one run, none has none."""
    if 0 < len(hashes) < length:
        return sequence_hashes(hashes, len(hashes))
    return sequence_hashes(hashes, length)


def occurrence_labels(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    labels = np.empty(n, np.int64)
    labels[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return labels
