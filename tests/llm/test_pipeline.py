import corpus_pipeline
import pytest

from fathom.llm import queries
from fathom.llm.quality import fit, with_score

from .conftest import SCHEMA, words

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "source mix"]
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 11)) and "pipeline" in queries.QUERIES
    assert set(queries.CHECKS) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rows = df.count()
    if name.startswith("op") and name != "op1_decontamination":
        source = "pages" if name.startswith(("op5", "op10")) else "documents"
        assert rows == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
    assert rows > 0 and len(set(df.columns)) == len(df.columns)


@pytest.fixture
def folder(spark, tmp_path):
    def lay(docs, labels, items):
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return lay


def test_each_stage_takes_effect(spark, folder):
    def doc(k, text, source="a"):
        return (k, text, "en", source, len(text))

    def junk(seed):
        return " ".join(w for w in words(seed, 12).split() for _ in range(8)).upper()

    docs = [doc(k, "\n".join(words(1000 + 10 * k + j, 30) for j in range(4)), "ab"[k % 2]) for k in range(120)]
    docs += [doc(200 + k, junk(k)) for k in range(60)]
    copy = docs[7][1].split()
    copy[20] = "altered"
    docs += [doc(300, " ".join(copy)), doc(301, docs[8][1]), doc(302, docs[8][1])]
    item = words(5555, 25)
    docs += [doc(400, f"{words(7001, 40)}\n{item}\n{words(7002, 40)}")]
    docs += [doc(500 + k, f"{words(8000 + k, 40)}\nThis line stands in many texts, word for word.") for k in range(9)]
    labels = [(k, 1, 0) for k in range(120)] + [(200 + k, 0, 0) for k in range(60)]
    path = folder(docs, labels, [(1, item), (2, words(5556, 25))])
    got, states = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, got, path)
        if k < 4:
            assert out.columns == got.columns
        out.write.parquet(f"{path}/stage{k}")
        got = spark.read.parquet(f"{path}/stage{k}")
        states.append({r.doc_id: r for r in got.collect()})
        assert len(states[-1]) == got.count()
    good, lines, near, clean, mixed = states
    assert set(good) == {d[0] for d in docs if not 200 <= d[0] < 260}
    assert set(lines) == set(good)
    assert [k for k in lines if "many texts" in lines[k].text] == [500] and lines[505].n_chars == len(lines[505].text)
    assert set(near) == set(lines) - {300, 301, 302}
    assert set(clean) == set(near) - {400}
    assert set(mixed) == set(clean) and sum(r.taken for r in mixed.values()) > 0
    whole = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {k: r.taken for k, r in mixed.items()}


def test_odd_rows(spark, folder, odd_rows):
    labels = [(1, 1, 0), (2, None, None), (None, 0, 0)]
    path = folder(odd_rows, labels, [(1, None), (2, "")])
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumnsRenamed({"lang": "leaks", "source": "source"})
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.collect()
    model = fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert with_score(spark.read.parquet(f"{path}/documents.parquet"), model).count() == len(odd_rows)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, path)
    assert empty.count() == 0
