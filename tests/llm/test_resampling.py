import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fathom.llm import resampling
from fathom.llm.resampling import bucket_counts, cutoff, feature_buckets, resample, span_checksums

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)], len(w)


def brute(rows, target, longest=1, share=10, least=20, buckets=10_000, seed=2024):
    """doc_id, n_features, weight, score, rank of rows (doc_id, text)."""
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    found = [features(t, longest) for _, t in rows]
    s = Counter(crc(f) for fs, _ in found for f in fs)
    t = Counter(crc(f) for x in target for f in features(x, longest)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s
    }
    out = []
    for (i, _), (fs, n) in zip(rows, found):
        weight = sum(gain[crc(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n):
    rows = [(k, words(k % 70, 5 + k * 7 % 60) + (" shared target words" if k % 5 == 0 else "")) for k in range(n)]
    return rows, ["shared TARGET words", words(3, 30), None, ""]


@pytest.mark.parametrize("longest, share", [(1, 10), (2, 35), (3, 100)])
def test_draw_equals_brute_force(spark, longest, share):
    rows, target = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample(docs, goal, longest=longest, share=share)) == brute(rows, target, longest, share)


def test_odd_rows(spark, odd_rows, odd, empty):
    target = spark.createDataFrame([("word word",)], "text string")
    rows = [(r[0], r[1]) for r in odd_rows]
    assert got(resample(odd, target, share=60)) == brute(rows, ["word word"], share=60)
    assert got(resample(odd, target.limit(0), share=60)) == brute(rows, [], share=60)
    assert resample(empty, target).collect() == []
    assert resample(empty, target).dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]


def test_clashing_columns(spark):
    rows = [(k, words(k, 30), "x", 1.0, 2) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string, score double, rank int")
    target = spark.createDataFrame([("a b c", "no")], "text string, n_words string")
    assert got(resample(docs, target)) == brute([r[:2] for r in rows], ["a b c"])


def test_repeated_rows_are_numbered_one_by_one(spark):
    rows = [(1, words(1, 30))] * 50 + [(k, words(k, 30)) for k in range(2, 52)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = [r for r in resample(docs, docs, share=30).collect() if r.rank is not None]
    assert sorted(r.rank for r in drawn) == list(range(1, 31))


def test_checksums_equal_the_library():
    raw = [b"", b"a", b"abc", "é".encode() * 40, b"x" * 100, b"z" * 64, b"z" * 65]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(x) for x in raw])
    assert span_checksums(data, np.cumsum(sizes) - sizes, sizes).tolist() == [zlib.crc32(x) for x in raw]


def test_runs_stay_within_rows():
    raw = [b"one two", b"", b"three", b"four five six"]
    data = np.frombuffer(b"".join(raw), np.uint8)
    found, rows, counts = feature_buckets(data, np.cumsum([0, *map(len, raw)]), 2, 1 << 31)
    want = {(0, b"one"), (0, b"two"), (0, b"one two"), (2, b"three"), (3, b"four five"), (3, b"five six")}
    want |= {(3, b"four"), (3, b"five"), (3, b"six")}
    assert sorted(zip(rows.tolist(), found.tolist())) == sorted((r, zlib.crc32(f) % (1 << 31)) for r, f in want)
    assert counts.tolist() == [2, 0, 1, 3]


@pytest.mark.parametrize("margin", [0.0, 0.00001, 0.4])
def test_bracket_is_widened_until_it_holds_the_cutoff(spark, margin):
    values = [k * k % 1009 for k in range(3000)] + [500] * 2000
    scores = spark.createDataFrame([(v,) for v in values], "score long")
    ranked = sorted(values, reverse=True)
    for wanted in (1, 7, 1500, 2600, 4999, 5000):
        assert cutoff(scores, wanted, len(values), margin=max(margin, 1e-6)) == ranked[wanted - 1]
    assert cutoff(scores, 0, len(values)) is None


def test_counts_cover_all_rows(spark):
    docs = spark.range(5000).selectExpr("concat('w', id % 3, ' W', id % 3) AS text")
    counts = bucket_counts(docs)
    assert counts.sum() == 10_000
    assert counts[zlib.crc32(b"w0") % resampling.BUCKETS] == 3334
