import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import jaccard
from fathom.llm.blocks import SMALL_ROWS, _aligned, likely_pairs, parity_marks

from .conftest import words


def _numbers(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))


@pytest.mark.parametrize(("n", "size"), [(1, 128), (100, 128), (500, 128), (600, 256), (20000, 1024)])
def test_marks_are_short_and_differ_by_no_more_than_the_sets(n, size):
    rng = np.random.default_rng(n)
    one = _numbers(rng, n)
    assert len(parity_marks(one)) == size
    # Sets of other sizes have marks of other lengths.
    for taken, added in ((0, 0), (n // 20, n // 10), (n // 2, 0), (0, 2 * n)):
        two = np.concatenate((one[taken:], _numbers(rng, added)))
        apart = len(np.setxor1d(one, two))
        first, second = _aligned([parity_marks(one).tobytes(), parity_marks(two).tobytes()])
        differ = int(np.bitwise_count(first ^ second).sum())
        assert differ <= apart and 3 * differ >= min(apart, n // 2)


@pytest.mark.parametrize("forest", [False, True])
@pytest.mark.parametrize("size", [2, SMALL_ROWS, SMALL_ROWS + 1])
def test_pairs_of_small_and_large_buckets(spark, size, forest):
    """All near pairs of different classes once each, in whatever number of buckets they meet."""
    rng = np.random.default_rng(size)
    base = _numbers(rng, 300)
    sets = [base[i:] if i % 2 == 0 else _numbers(rng, 300) for i in range(size)]
    parities = spark.createDataFrame([(i, bytearray(parity_marks(s).tobytes())) for i, s in enumerate(sets)], "key long, parity binary")
    rows = [(b, i, i, len(s), False, False) for b in range(5) for i, s in enumerate(sets)]
    rows = spark.createDataFrame(rows, "bucket long, key long, root long, n_shingles long, kin boolean, far boolean")
    found = sorted(tuple(r) for r in likely_pairs(rows, parities, 0.9, forest=forest).collect())
    near = list(combinations(range(0, size, 2), 2))
    if forest and size > SMALL_ROWS:
        assert set(found) <= set(near) and len(found) >= len(range(0, size, 2)) - 1
    else:
        assert found == near
    nothing = rows.withColumn("kin", F.col("key") % 2 == 0).withColumn("far", F.lit(True))
    assert likely_pairs(nothing, parities, 0.9).isEmpty()
    assert likely_pairs(rows.withColumn("root", F.lit(1).cast("long")), parities, 0.9).isEmpty()


def test_whole_sets_are_shuffled_and_texts_are_not(spark, monkeypatch, capsys):
    texts = [words(i, 40) for i in range(30)]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (8, "another text of eight words in all")], "doc_id long, text string")
    keys = [jaccard._key(t) for t in jaccard._sets(jaccard.pa.array(texts), 3)]
    wanted = spark.createDataFrame([(bytearray(keys[i]), i if i else None, 100 + i) for i in (0, 7, 8, 20)], "key binary, doc_id long, node long")
    plans, write = [], jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, label: (plans.append((label, df)), write(df, label))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = {r.key: r for r in jaccard._whole_sets(docs, wanted, 3).collect()}
        dict(plans)["sets"].explain(mode="formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(sets) == [100, 107, 108, 120]
    assert all(jaccard._key(np.frombuffer(r.members, np.uint64)) == keys[k - 100] for k, r in sets.items())
    shuffled = re.findall(r"\) Exchange\n?\s*Input \[\d+\]: \[(.*?)\]", capsys.readouterr().out)
    assert shuffled and not any("text#" in columns for columns in shuffled)
