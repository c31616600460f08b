"""Stored postings and indexes by difference, against fresh indexes."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import bm25, postings, scoring, snapshots
from attesta.vocabulary import STATUSES, RetrievalConfig

COLUMNS = "doc_id string, doc_title string, doc_type string, version string, status string, department string, source_file_path string, source_hash string, raw_text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of and".split()


def document(r, i, status=None):
    text = "\n\n".join(" ".join(r.choices(WORDS, k=r.randint(1, 12))) for _ in range(r.randint(0, 5)))
    return (f"D{i}", f"T{i}", "SOP", "1.0", status or r.choice(STATUSES), "QA", f"documents/{i}.md", f"sha256:{hash(text) & (2**64 - 1):064x}", text)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def asked(spark):
    rows = [("q1", "alpha beta the the"), ("q2", "kappa"), ("q3", "none of these nowhere"), ("q4", ""), ("q5", "unknown")]
    return spark.createDataFrame(rows, "query_id string, question string")


def found(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("slot_rows, picked", [(10**6, 10**4), (7, 10**4), (7, 2)])
def test_stored_postings_give_the_same_hits(spark, tmp_path, monkeypatch, slot_rows, picked):
    """Frequent tokens over several slots; words that pick buckets, and words that are joined."""
    monkeypatch.setattr(postings, "SLOT_ROWS", slot_rows)
    r = random.Random(1)
    index = bm25.build_retriever(frame(spark, [document(r, i) for i in range(60)]))
    at = str(tmp_path / "index")
    postings.save(index, at, buckets=8)
    stored = postings.load(spark, at, picked)
    want = found(bm25.score(index, asked(spark)))
    assert found(bm25.score(stored, asked(spark))) == want and want
    config = RetrievalConfig(top_k=3)
    assert found(bm25.hits(stored, asked(spark), config)) == found(bm25.hits(index, asked(spark), config))
    assert found(stored.idf) == found(index.idf)
    index.release()


def test_stored_postings_are_lists(spark, tmp_path):
    """A row for each word of a block of chunks, scores only of a task's best, no join; chunks that share an
    id count as one."""
    r = random.Random(4)
    rows = [document(r, i, "Approved") for i in range(40)]
    rows += [rows[0], (*rows[1][:8], "alpha beta the")]
    index = bm25.build_retriever(frame(spark, rows))
    at = str(tmp_path / "index")
    postings.save(index, at, buckets=8)
    stored = postings.load(spark, at)
    lists = stored.postings.filter("token IS NOT NULL")
    single = bm25.term_frequency(index.chunks)
    assert lists.count() < single.count() / 4
    assert lists.select(F.explode("tf").alias("tf")).agg(F.sum("tf")).first()[0] == single.agg(F.sum("tf")).first()[0]
    assert index.repeats() and found(bm25.score(stored, asked(spark))) == found(bm25.score(index, asked(spark)))
    index.release()
    best = bm25._by_blocks(stored, asked(spark), lambda t, w: scoring.best(t, w, 2, 0.0))
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_documents_stored_at_once_give_the_same_index(spark, tmp_path):
    r = random.Random(6)
    docs = frame(spark, [document(r, i) for i in range(30)])
    index = bm25.build_retriever(docs)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    postings.save(index, one, buckets=8)
    postings.build(docs, two, buckets=8)
    a, b = postings.load(spark, one), postings.load(spark, two)
    assert found(b.chunks.select(a.chunks.columns)) == found(a.chunks) and found(b.words) == found(a.words)
    config = RetrievalConfig(top_k=3)
    assert found(bm25.hits(b, asked(spark), config)) == found(bm25.hits(index, asked(spark), config))
    index.release()


def test_a_question_reads_the_buckets_of_its_words(spark, tmp_path):
    r = random.Random(2)
    index = bm25.build_retriever(frame(spark, [document(r, i) for i in range(30)]))
    at = str(tmp_path / "index")
    postings.save(index, at, buckets=64)
    index.release()
    stored = postings.load(spark, at)
    kappa = spark.createDataFrame([("kappa",)], "token string")
    one = stored.frequencies(kappa)
    files = stored.postings.filter(F.col("slot").isin(["kappa\n0"]))
    assert files.rdd.getNumPartitions() == 1 < stored.postings.rdd.getNumPartitions()
    assert one.count() > 0
    # the planner shows the buckets where it is told to scan by bucket
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(auto, "false")
    try:
        plan = stored.frequencies(kappa)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(auto)
    assert plan.count("SelectedBucketsCount: 1 out of 64") == 2, plan
    assert "Generate explode(tokens" not in plan
    many = postings.load(spark, at, picked=0).frequencies(spark.createDataFrame([("kappa",), ("eta",)], "token string"))
    assert found(many.filter("token = 'kappa'")) == found(one)


@pytest.mark.parametrize("seed", range(4))
def test_an_index_by_difference_equals_a_fresh_one(spark, tmp_path, seed):
    """Additions, removals, other texts, other statuses, repeated rows; two updates in a row."""
    r = random.Random(seed)
    gate = seed != 3
    rows = [document(r, i) for i in range(25)] + [document(r, 99, "Approved")] * 2
    at = snapshots.take(frame(spark, rows), gate).save(str(tmp_path / "0"))
    for step in (1, 2):
        new = []
        for row in rows:
            kind = r.random()
            if kind < 0.15:
                continue
            if kind < 0.3:
                row = (*row[:4], r.choice(STATUSES), *row[5:])
            elif kind < 0.45:
                row = document(r, row[0][1:])
            new += [row] * (2 if kind > 0.95 else 1)
        rows = new + [document(r, 100 * step + i) for i in range(4)]
        at = snapshots.update(at, frame(spark, rows), gate).save(str(tmp_path / str(step)))
        index, fresh = at.index(), bm25.build_retriever(frame(spark, rows), gate=gate)
        assert found(index.stats) == found(fresh.stats)
        assert found(index.idf) == found(fresh.idf)
        assert found(index.chunks.select(fresh.chunks.columns)) == found(fresh.chunks)
        assert found(bm25.score(index, asked(spark))) == found(bm25.score(fresh, asked(spark)))
        fresh.release()


def test_only_changes_are_chunked(spark, tmp_path):
    r = random.Random(7)
    rows = [document(r, i, "Approved") for i in range(10)]
    old = snapshots.take(frame(spark, rows)).save(str(tmp_path / "0"))
    same = snapshots.update(old, frame(spark, rows))
    assert same.chunks.exceptAll(old.chunks).count() == 0 and found(same.totals) == found(old.totals)
    empty = snapshots.update(old, frame(spark, rows).limit(0))
    assert empty.df.count() == 0 and found(empty.totals) == ["Row(n_chunks=0, n_tokens=0)"]
    assert empty.index().stats.first()["avg_tokens"] is None
    assert snapshots.update(empty, frame(spark, rows)).df.agg(F.sum("df")).first()[0] == old.df.agg(F.sum("df")).first()[0]
