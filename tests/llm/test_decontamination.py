import random

from fathom.llm.decontamination import ItemIndex, contained, find_leaks, question_and_answer, word_hashes

from .conftest import words


def test_wand_returns_all_items_at_or_above_the_threshold():
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(1, 25)))) for k in range(300)]
    index = ItemIndex.build(items)
    for turn in range(40):
        query = word_hashes(" ".join(draw.choices(vocabulary, k=30)))
        terms = sorted(set(index.term_numbers(query)[1].tolist()))
        full = {}
        for t in terms:
            for p in range(index.bounds[t], index.bounds[t + 1]):
                full[index.items[p]] = full.get(index.items[p], 0.0) + index.scores[p]
        for threshold in (0.2, 0.5, 0.8):
            got = dict(index.search(terms, threshold))
            want = {i: s for i, s in full.items() if s >= threshold - 1e-9}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_own_words_score_one():
    index = ItemIndex.build([(k, words(k, 20)) for k in range(50)])
    terms = sorted(set(index.term_numbers(word_hashes(words(7, 20)))[1].tolist()))
    assert [i for i, s in index.search(terms, 0.99)] == [7]


def test_question_and_answer():
    assert question_and_answer("Who was it? Nobody.") == ("Who was it?", " Nobody.")
    assert question_and_answer("first\nsecond") == ("first", "second")
    assert question_and_answer("One here. Two there.") == ("One here.", "Two there.")
    assert question_and_answer("just one") == ("just one", "just one")


def brute(docs, items, size):
    """Every item against every passage, without an index."""
    found = set()
    for i, text in docs:
        hashes = word_hashes(text or "")
        for start in range(0, max(1, len(hashes)), size // 2):
            passage = hashes[start : start + size]
            for j, item in items:
                parts = [word_hashes(p) for p in question_and_answer(item or "")]
                if len(word_hashes(item or "")) and all(contained(p, passage, 5) >= 0.8 for p in parts):
                    found.add((i, j))
    return found


def test_leaks_equal_brute_force(make):
    items = [(k, f"{words(k, 12 + k % 9)}. {words(50 + k, 6)}.") for k in range(40)] + [(90, None), (91, "..."), (92, "")]
    docs = [(k, words(300 + k, 400)) for k in range(30)]
    docs += [(100 + k, f"{words(400 + k, 90)} {items[k][1].upper()} {words(700 + k, 200)}") for k in range(20)]
    docs += [(200 + k, f"{words(600 + k, 50)} {words(k, 12 + k % 9)} {words(800 + k, 50)}") for k in range(10)]
    docs += [(300, " ".join(t for _, t in items[:30])), (301, items[5][1] + "\n" + words(9000, 3)), (302, None), (303, "")]
    longest = max(len(word_hashes(t or "")) for _, t in items)
    got = find_leaks(make(docs), make(items, "item_id long, text string")).select("doc_id", "leaks.item_id").collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, j) for r in got for j in r.item_id} == brute(docs, items, 2 * longest)
    few = find_leaks(make(docs), make(items, "item_id long, text string"), index_bytes=700)
    assert {(r.doc_id, tuple(sorted(r.item_id))) for r in got} == {
        (r.doc_id, tuple(sorted(r.item_id))) for r in few.select("doc_id", "leaks.item_id").collect()
    }


def test_odd_rows(odd, empty, make, odd_rows):
    items = make([(1, words(2, 30)), (2, words(2, 30)), (None, words(1, 60))], "item_id long, text string")
    named = odd.withColumnRenamed("lang", "LEAKS").withColumnRenamed("source", "leaks_0")
    got = find_leaks(named, items)
    assert got.columns == ["doc_id", "text", "leaks_0", "n_chars", "leaks"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append([x.item_id for x in r.leaks])
    assert by[None] == [[1, 2]] and by[1] == [[None]] and by[2] == [[None], [None]] and by[3] == by[4] == [[]] and by[6] == [[1, 2]]
    assert find_leaks(empty, items).count() == 0
    assert all(not r.leaks for r in find_leaks(odd, make([], "item_id long, text string")).collect())
