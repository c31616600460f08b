"""Many corpora in one index, against an index of each."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import bm25, libraries
from attesta.vocabulary import STATUSES, RetrievalConfig

COLUMNS = "corpus string, doc_id string, doc_title string, doc_type string, version string, status string, department string, source_file_path string, source_hash string, raw_text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of and".split()
ASKED = [("q1", "alpha beta the the"), ("q2", "kappa"), ("q3", "none of these"), ("q4", ""), ("q5", "unknown")]


def document(r, corpus, i):
    text = "\n\n".join(" ".join(r.choices(WORDS, k=r.randint(1, 12))) for _ in range(r.randint(0, 4)))
    return (corpus, f"D{i}", f"T{i}", "SOP", "1.0", r.choice(STATUSES), "QA", f"documents/{i}.md", "x", text)


@pytest.fixture(scope="module")
def documents(spark):
    """A corpus with most documents, ids that stand in all, an empty name, documents without a corpus."""
    r = random.Random(3)
    rows = [document(r, c, i) for c, n in (("main", 40), ("b", 9), ("", 7), (None, 5)) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(c, q, text) for c in ("main", "b", "", "gone", None) for q, text in ASKED]
    return spark.createDataFrame(rows, "corpus string, query_id string, question string")


def found(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def each(documents, queries, run, gate):
    """run(index, queries) over an index of each corpus alone."""
    out = []
    for corpus in ("main", "b", ""):
        index = bm25.build_retriever(documents.filter(F.col("corpus") == corpus).drop("corpus"), gate=gate)
        got = run(index, queries.filter(F.col("corpus") == corpus).drop("corpus"))
        out += found(got.withColumn("corpus", F.lit(corpus)))
        index.release()
    return sorted(out)


def test_a_library_gives_what_each_index_gives(spark, documents, queries, tmp_path):
    config = RetrievalConfig(top_k=3)
    built = libraries.build(documents)
    libraries.save(built, str(tmp_path))
    stored = libraries.load(spark, str(tmp_path))
    scores = each(documents, queries, bm25.score, True)
    hits = each(documents, queries, lambda i, q: bm25.hits(i, q, config), True)
    assert scores and hits
    for library in (built, stored):
        assert found(libraries.score(library, queries)) == scores
        assert found(libraries.hits(library, queries, config)) == hits
    built.release()


def test_held_out_hits_are_each_corpus_own(documents, queries):
    config = RetrievalConfig(top_k=4)
    blind = libraries.build(documents, gate=False)
    want = each(documents, queries, lambda i, q: bm25.held_out(i, q, config), False)
    assert found(libraries.held_out(blind, queries, config)) == want and want
    blind.release()


def test_questions_read_the_folders_of_their_corpora(spark, documents, queries, tmp_path, monkeypatch):
    built = libraries.build(documents)
    libraries.save(built, str(tmp_path))
    built.release()
    stored = libraries.load(spark, str(tmp_path))
    one = queries.filter("corpus = 'b'")
    parts = stored.of(one.select("corpus").distinct()).chunks
    assert {r["corpus"] for r in parts.select("corpus").distinct().collect()} == {"b"}
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan
    want = found(libraries.score(stored, one))
    monkeypatch.setattr(libraries, "MANY", 0)
    assert found(libraries.score(stored, one)) == want and want


def test_no_documents_or_questions(documents, queries):
    empty = libraries.build(documents.filter("false"))
    assert found(libraries.hits(empty, queries, RetrievalConfig())) == []
    empty.release()
    built = libraries.build(documents)
    assert found(libraries.hits(built, queries.filter("false"), RetrievalConfig())) == []
    built.release()
