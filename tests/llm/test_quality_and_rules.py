import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm.batches import text_bytes
from fathom.llm.quality import feature_hashes, fit, held_out, keep_good, train, with_score
from fathom.llm.rules import BASE, MEASURES, PROSE, Rule, Text, cascade, first_failure, ordered_rules, trial

from .conftest import words


def labelled():
    rows = []
    for k in range(300):
        good = k % 3 > 0
        text = words(k, 60) if good else " ".join(w for w in words(k, 12).split() for _ in range(6)).upper() + "!!"
        rows.append((k, text, int(good)))
    return rows


def test_held_out_accuracy(make):
    rows = labelled()
    docs = make([r[:2] for r in rows])
    model = fit(docs, make([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    got = with_score(docs, model).withColumn("held_out", held_out()).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    unseen = [(r.score >= 0.3) == bool(rows[r.doc_id][2]) for r in got if r.held_out]
    assert len(unseen) > 30 and np.mean(unseen) > 0.97


def test_held_out_labels_do_not_matter(make):
    rows = labelled()
    docs = make([r[:2] for r in rows])
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    one = fit(docs, make([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    two = fit(docs, make(flipped, "doc_id long, quality int"))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_features_stay_in_their_row():
    together = feature_hashes(*text_bytes(pa.array(["aé b", "", "c c d", None, "end"])), 17)
    for row, text in enumerate(["aé b", "", "c c d", "", "end"]):
        alone, _ = feature_hashes(*text_bytes(pa.array([text])), 17)
        assert sorted(together[0][together[1] == row].tolist()) == sorted(alone.tolist())


def test_odd_rows_have_scores(odd, empty, make):
    labels = make([(1, 1), (2, 0), (2, 1), (6, 0), (9, None), (None, 1), (7, 5), (77, 1)], "doc_id long, quality int")
    model = fit(odd, labels)
    got = with_score(odd.withColumnRenamed("lang", "Score"), model)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "score"]
    assert all(0 <= r.score <= 1 for r in got.collect()) and with_score(empty, model).count() == 0
    nothing = fit(empty, labels)
    assert {r.score for r in with_score(odd, nothing).collect()} == {0.5}
    assert keep_good(odd, nothing).count() == odd.count() and keep_good(odd, nothing).columns == odd.columns
    assert train(np.empty(0, int), [], [], 8).bias == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    found = WORD.findall(text)
    seen, covered = {}, set()
    for k in range(len(found) - 7):
        seen.setdefault(tuple(found[k : k + 8]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(found), "word_chars": sum(map(len, found)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_measures_equal_brute_force():
    draw = random.Random(2)
    texts = ["", " ", "a", "\x85 \x1c b\x0bc", "a b c d e f g h a b c d e f g h", "x\n x\nx\n\nx\r\nx\n", "é#* |" * 30]
    texts += ["".join(draw.choices("ab \n#é", k=draw.randint(0, 400))) for _ in range(60)]
    for text in texts:
        one = Text(text)
        want = brute(text)
        assert {name: one.get(name) for name in want} == want


def test_cascade_keeps_what_no_rule_rejects(odd, empty, odd_rows):
    names = ("n_words", "n_repeat_words")
    got = cascade(odd.withColumnRenamed("lang", "KEPT"), reported=names)
    assert got.columns == ["doc_id", "text", "source", "n_chars", *names, "failed_rule", "kept"]
    for r in got.collect():
        fails = [x.name for x in BASE + PROSE if x.fails(*map(Text(r.text or "").get, x.measures))]
        assert r.kept == (not fails) and (r.failed_rule in fails or r.kept)
    assert cascade(empty).count() == 0


def test_order_is_rejections_per_cost(monkeypatch):
    cheap = Rule("cheap", ("n_symbols",), lambda n: n > 0)
    dear = Rule("dear", ("n_upper",), lambda n: n > 0)
    idle = Rule("idle", ("n_lines",), lambda n: False)
    names = list(MEASURES)
    cost = [0.0] * len(names)
    cost[names.index("n_symbols")], cost[names.index("n_upper")] = 1.0, 3.0
    assert [r.name for r in ordered_rules((idle, dear, cheap), [(cost, [False, True, True])])] == ["cheap", "idle", "dear"]
    twice = [(cost, [False, True, False])] * 4 + [(cost, [False, False, True])]
    assert [r.name for r in ordered_rules((idle, dear, cheap), twice)] == ["dear", "cheap", "idle"]
    assert [r.name for r in ordered_rules((idle, dear), [])] == ["idle", "dear"]
    measured = []
    monkeypatch.setitem(MEASURES, "n_upper", lambda t: measured.append(t) or 0)
    assert first_failure(Text("#"), [cheap, dear]) == "cheap" and not measured
    spent, failed = trial((cheap, dear), "a#")
    assert failed == [True, False] and len(spent) == len(MEASURES) and all(s >= 0 for s in spent)


@pytest.mark.parametrize("text", [words(1, 200), words(2, 30), "Ein Satz, der gut ist. " + words(3, 50)])
def test_prose_is_kept(text):
    assert first_failure(Text(text), list(BASE + PROSE)) is None
