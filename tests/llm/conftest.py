"""Small tables with every odd case: null, empty and long texts, ties, repeated rows, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    """Invented words, different for every seed."""
    state, out = seed * 7919 + 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("".join("bcdfghklmnprstvz"[state >> s & 15] + "aeiou"[(state >> s) % 5] for s in (4, 11, 18)))
    return " ".join(out)


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    long_text = "\n".join(words(k, 40) for k in range(800))
    return [
        (1, words(1, 60), "en", "a", 1),
        (2, words(1, 60), "en", "a", 2),
        (2, words(1, 60), "en", "a", 2),
        (3, None, None, None, None),
        (None, words(2, 30), "de", None, 3),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, long_text, "en", "c", 5),
        (7, "word", "", "c", 6),
        (8, "é" * 300, "fr", "ü", 7),
        (8, "ü" * 300, "fr", "ü", 7),
        (9, "x" * 50_000, "fr", "ü", 7),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
