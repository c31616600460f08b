"""Scores by blocks of questions against scores by joins, and what an index keeps."""

import random
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_stored import asked, document, frame, found

from attesta.operators import bm25, libraries, scoring
from attesta.plans import catalog
from attesta.vocabulary import RetrievalConfig


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [document(r, i, "Approved") for i in range(60)] + [(*document(r, 200 + i, "Approved")[:8], "alpha w1 w2\n\nthe of") for i in range(20)]
    docs = [(*d[:8], f"{d[8]}\n\n{' '.join(r.choices(words, k=6))}") for d in docs]
    rows = [(f"q{i}", " ".join(r.choices([*words, "alpha", "the", "of"], k=r.randint(1, 90)))) for i in range(50)]
    index = bm25.build_retriever(frame(spark, docs))
    yield index, asked(spark).unionByName(spark.createDataFrame(rows, "query_id string, question string"))
    index.release()


def by_joins(index, queries):
    return bm25._named(bm25._keyed_scores(index, queries), index).select("query_id", "score", "doc_id", "chunk_index", "chunk_id")


@pytest.mark.parametrize("questions, entries, dense", [(4096, 1 << 22, 1 / 300), (7, 64, 0.0), (20, 200, 2.0)])
def test_blocks_give_what_joins_give(many, monkeypatch, questions, entries, dense):
    """Blocks of any size, all words dense or none, ties of many equal chunks."""
    index, queries = many
    for name, value in {"QUESTIONS": questions, "ENTRIES": entries, "DENSE": dense}.items():
        monkeypatch.setattr(scoring, name, value)
    want = by_joins(index, queries)
    assert found(bm25.score(index, queries)) == found(want)
    for k in (1, 4):
        got = bm25.top(index, queries, k, 0.5)
        assert found(got) == found(bm25.rank(want, k, 0.5).select(got.columns))


def test_tasks_pass_on_their_best_alone(many):
    """No row of a score beyond a question's k best of each task, and no join of words with chunks."""
    index, queries = many
    terms = index.slim()
    rows = bm25._by_blocks(index, queries, lambda t, w: scoring.best(t, w, 2, 0.0))
    assert rows.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 2 * terms.rdd.getNumPartitions()
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]


def test_an_index_keeps_names_and_words_alone(many):
    index, _ = many
    assert not index.chunks.is_cached and index.slim().is_cached and not index.slim().storageLevel.useMemory
    assert index.slim().columns == ["doc_id", "chunk_index", "chunk_id", "n_tokens", "words"]


def test_words_are_counted_once(many):
    """Questions read the kept frequencies; none explodes the words of all chunks again."""
    index, _ = many
    assert index.counted.is_cached and not index.counted.storageLevel.useMemory
    plan = index.idf._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation [token") == 2 and index.counted.count() == index.idf.count()


def test_coverage_follows_from_kept_words(many):
    """Coverage of hits without chunking a document again."""
    index, queries = many
    config = RetrievalConfig(top_k=3)

    def again(documents):
        raise AssertionError("documents are chunked again")

    got = bm25.covered(replace(index, chunks_of=again), queries, config)
    want = bm25.hits(index, queries, config, gate=False)
    assert found(got) == found(want.select(got.columns))
    best = bm25.covered(index, queries, config, last=1)
    assert found(best) == found(want.filter("rank = 1").select(got.columns))


def test_chunks_that_share_an_id_count_as_one(spark):
    r = random.Random(3)
    rows = [document(r, i, "Approved") for i in range(9)]
    index = bm25.build_retriever(frame(spark, [*rows, rows[0]]))
    assert index.repeats()
    keys = bm25.score(index, asked(spark)).groupBy("query_id", "chunk_id").count()
    assert keys.filter("count > 1").count() == 0
    index.release()


def test_a_library_keeps_names_and_words_alone(spark):
    """Corpora with odd names, scored by blocks as by joins."""
    r = random.Random(8)
    docs = frame(spark, [document(r, i, "Approved") for i in range(24)])
    docs = docs.withColumn("corpus", F.when(F.col("doc_id").endswith("1"), "a b:c").otherwise("d\n"))
    queries = asked(spark).select(F.explode(F.array(F.lit("a b:c"), F.lit("d\n"))).alias("corpus"), "query_id", "question")
    library = libraries.build(docs)
    assert not library.chunks.is_cached and library.slim().is_cached and not library.slim().storageLevel.useMemory
    got = libraries.score(library, queries)
    want = libraries._joined(library, queries).select(got.columns)
    assert found(got) == found(want) and got.count() > 0
    library.release()


def test_coverage_of_best_hits_reads_documents_once(spark, monkeypatch):
    """The query of coverages alone never asks for the chunks of its hits."""

    def again(*_, **__):
        raise AssertionError("chunks of hits are made again")

    monkeypatch.setattr(bm25.Index, "named", again)
    assert catalog.QUERIES["coverage_rank1"](spark, "/root/testdata/sf0.001").count() > 0


def in_memory(n_questions, n_rows, n_words, sign=1):
    """Questions that ask all words, and rows that hold them all, with weights of up to 46 bits."""
    r = np.random.default_rng(4)
    q, t = (x.ravel() for x in np.meshgrid(np.arange(n_questions), np.arange(n_words)))
    order = np.argsort(t, kind="stable")
    idf = np.full(n_words, float(sign))
    ids, words = (pa.array([f"{k}{i}" for i in range(n)]) for k, n in (("q", n_questions), ("w", n_words)))
    blocks = scoring.Questions(ids, words, idf, np.ones(n_words), q[order], t[order], r.integers(1, 9, len(q)))
    rows, tokens = (x.ravel() for x in np.meshgrid(np.arange(n_rows), np.arange(n_words), indexing="ij"))
    w = sign * r.integers(1, 1 << 46, len(rows))
    names = pa.record_batch({n: pa.array(np.arange(n_rows)) for n in scoring.NAMES})
    return blocks, names, scoring.Postings(rows, tokens, w, np.arange(n_rows + 1) * n_words)


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_all_scores_of_a_block_take_little_memory():
    """Memory follows the block's scores, not the words that its pairs share: here 4 million."""
    block, names, p = in_memory(64, 1000, 64)
    task = scoring._all_of(block, lambda batches, asked: iter([(names, p)]))
    assert peak_mb(lambda: [b.num_rows for b in task(iter([]))]) < 40


def test_best_of_long_rows_take_little_memory():
    """Nor do exact sums of rows with many words follow rows times words: here 8 million."""
    block, names, p = in_memory(20, 400, 1000)
    q, r = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(400)))
    assert peak_mb(lambda: scoring._exact(block, p, q, r)) < 40


@pytest.mark.parametrize("dense", [0.0, 1 / 300, 2.0])
@pytest.mark.parametrize("sign", [1, -1])
def test_whole_scores_are_exact(monkeypatch, dense, sign):
    """Sums in halves, of weights of either sign, against whole numbers in plain Python."""
    monkeypatch.setattr(scoring, "DENSE", dense)
    block, names, p = in_memory(5, 7, 30, sign)
    times = {(q, t): int(x) for q, t, x in zip(block.q.tolist(), block.t.tolist(), block.times)}
    want = [[sum(times[q, t] * int(p.w[r * 30 + t]) for t in range(30)) for r in range(7)] for q in range(5)]
    assert scoring._whole(block, p, 0, 7).tolist() == want
    assert scoring._whole(block, p, 3, 5).tolist() == [x[3:5] for x in want]
    task = scoring._all_of(block, lambda batches, asked: iter([(names, p)]))
    got = {(x["query_id"], x["doc_id"]): x["score"] for b in task(iter([])) for x in b.to_pylist()}
    assert got == {(f"q{q}", r): want[q][r] / scoring.UNIT for q in range(5) for r in range(7)}
