import hashlib
import re

from pyspark.sql import functions as F

from fathom.llm.secrets import ALPHABET, find_secrets, labelled_samples, matched, ratio, span_list, train

from .conftest import words

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
KEY = "AKIA" + "Q2W3E4R5T6Y7U8I9"
HASH = hashlib.sha1(b"x").hexdigest()
RANDOM = "Zq8Xr2Lw9Tk4Vb7NcP0dYs6H"


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


TEXTS = [
    "", f"é token={HASH} {KEY}x{HASH}", f"PassWord : 'abc' secret:token:abcdefgh api_key='{RANDOM}'", "token=token=abcdefgh",
    "my password is = none; passwd=12345 passwd=123456", f"AKIAAKIA{KEY} AKIA12", HASH[:23] + " " + HASH[:24], "𝔘 " + HASH + "\n" + HASH,
    f"secret = \"{KEY}\"", "apikey:x.y.z-1_2=/+ API_KEY=abcdef", f"{words(4, 50)} {RANDOM} {words(5, 20)}", words(6, 300),
    "getElementByIdentifierName internationalization_settings ---------------------- MAX_BUFFER_SIZE_LIMIT",
]


def scan(spark, make):
    docs = make(list(enumerate(TEXTS)))
    corpus = make([(k, words(k, 80)) for k in range(100)])
    model = train(labelled_samples(corpus))
    kinds = ["assign", "access", "hex"]
    found = find_secrets(docs, model)
    return model, found.select("doc_id", "random", span_list(kinds).alias("base"), span_list([*kinds, "random"]).alias("spans")).collect()


def test_spans(spark, make):
    model, rows = scan(spark, make)
    assert len(model) == len(ALPHABET) ** 2
    for r in rows:
        assert r.base == base(TEXTS[r.doc_id])
        assert set(r.base.split(",")) - {""} <= set(r.spans.split(","))
    found = {r.doc_id: [TEXTS[r.doc_id][s.start : s.end] for s in r.random] for r in rows}
    assert found[10] == [RANDOM] and found[11] == [] and found[12] == []
    assert found[2] == []


def test_ratio_is_a_sum_over_pairs(spark, make):
    model = [float(k % 13) for k in range(len(ALPHABET) ** 2)]
    codes = [ALPHABET.index(c) for c in RANDOM]
    want = sum(model[a * len(ALPHABET) + b] for a, b in zip(codes, codes[1:]))
    rows = make([(1, RANDOM), (2, "a"), (3, "")]).select(ratio(F.col("text"), model).alias("r")).collect()
    assert [r.r for r in rows] == [want, 0.0, 0.0]


def test_places_are_code_points(make):
    row = make([(1, "𝔘é12é345")]).select(matched(F.col("text"), "[0-9]+").alias("m")).first()
    assert [(s.start, s.end, s.value) for s in row.m] == [(2, 4, "12"), (5, 8, "345")]


def test_odd_rows(odd, empty, odd_rows):
    model = train(labelled_samples(odd))
    got = find_secrets(odd.withColumnRenamed("lang", "HEX"), model)
    assert [c.lower() for c in got.columns] == ["doc_id", "text", "hex", "source", "n_chars", "assign", "access", "random"]
    assert got.count() == len(odd_rows) and all(not r.assign for r in got.collect())
    assert find_secrets(empty, train(labelled_samples(empty))).count() == 0
