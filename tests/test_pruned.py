"""The best chunks of many questions, most pairs ruled out by bounds, against scores by joins."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_scoring import by_joins
from test_stored import document, found, frame

from attesta.operators import bm25, scoring
from attesta.plans import catalog


@pytest.fixture(scope="module")
def many(spark):
    """Words of all frequencies in chunks of all lengths, copies of chunks, and questions that repeat words."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = ["\n\n".join(" ".join(r.choices(words, weights, k=r.choice([1, 4, 20, 60]))) for _ in range(6)) for _ in range(60)]
    docs = [(*document(r, i, "Approved")[:8], texts[i % 50]) for i in range(60)]
    rows = [(f"q{i}", " ".join(r.choices(words, weights, k=r.randint(1, 40)))) for i in range(80)] + [("none", "nowhere"), ("empty", "")]
    index = bm25.build_retriever(frame(spark, docs))
    yield index, spark.createDataFrame(rows, "query_id string, question string")
    index.release()


@pytest.mark.parametrize("sizes", [{}, {"SLAB": 7, "HELD": 50, "RUN": 20, "OFTEN": 0.0}, {"WAITING": 5, "LOOK": 20, "FEW": 0}, {"WIDE": 30, "SPARED": 0.99, "FEW": 2}])
@pytest.mark.parametrize("k, floor", [(1, 0.0), (3, 0.0), (5, 2.5)])
def test_pruned_gives_what_joins_give(many, monkeypatch, sizes, k, floor):
    index, queries = many
    for name, value in {"QUESTIONS": 10, **sizes}.items():
        monkeypatch.setattr(scoring, name, value)
    got = bm25.top(index, queries, k, floor)
    assert found(got) == found(bm25.rank(by_joins(index, queries), k, floor).select(got.columns))


def test_many_questions_are_one_pass(many, monkeypatch):
    """Chunks are read once for many questions, not once for each block of them."""
    index, queries = many
    monkeypatch.setattr(scoring, "QUESTIONS", 10)
    rows = bm25._by_blocks(index, queries, lambda t, w: scoring.best(t, w, 2, 0.0))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_words_below_the_floor_leave_pairs_out(monkeypatch):
    """Pairs that share frequent words alone are never summed, once floors are known."""
    r = np.random.default_rng(2)
    texts = [" ".join(["the"] * r.integers(1, 4) + ["of"] + [f"x{i}" for i in range(r.integers(1, 30))] + (["rare"] if i % 100 == 0 else [])) for i in range(1000)]
    tokens = ["the", "of", "rare"]
    asked = scoring.Questions(pa.array(["q"]), pa.array(tokens), np.array([0.1, 0.2, 6.0]), np.full(3, 15.0), np.zeros(3, np.int64), np.arange(3), np.array([1, 2, 1]))
    batch = pa.record_batch({
        "doc_id": [f"d{i:04}" for i in range(1000)], "chunk_index": pa.array(range(1000), pa.int32()), "chunk_id": [f"c{i}" for i in range(1000)],
        "n_tokens": pa.array([len(t.split()) for t in texts], pa.int32()), "words": texts,
    })
    summed, exact = [], scoring._exact
    monkeypatch.setattr(scoring, "_exact", lambda a, p, q, r: summed.append(len(q)) or exact(a, p, q, r))
    counted, bincount = [], np.bincount
    want = pa.Table.from_batches(scoring._best_of(asked, 3, 0.0, scoring.of_texts)(iter([batch])))
    floors = np.array([want["score"].to_pylist()[-1]])
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: counted.append(len(x)) or bincount(x, *a, **b))
    summed.clear()
    got = pa.Table.from_batches(scoring._pruned_of(asked, 3, 0.0, floors)(iter([batch])))
    assert got.equals(want) and sum(summed) < 10
    assert 10 in counted  # of the rare word's chunks alone


def test_weights_below_zero(monkeypatch):
    """Words that lower a score bound nothing."""
    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choice(words, r.integers(1, 25))) for _ in range(400)]
    q, t = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(12)))
    order = np.argsort(t, kind="stable")
    asked = scoring.Questions(pa.array([f"q{i}" for i in range(5)]), pa.array(words), r.normal(1, 2, 12), np.full(12, 12.0), q[order], t[order], r.integers(1, 4, 60))
    batch = pa.record_batch({
        "doc_id": [f"d{i:04}" for i in range(400)], "chunk_index": pa.array(range(400), pa.int32()), "chunk_id": [f"c{i}" for i in range(400)],
        "n_tokens": pa.array([len(t.split()) for t in texts], pa.int32()), "words": texts,
    })
    want = pa.Table.from_batches(scoring._best_of(asked, 4, 0.0, scoring.of_texts)(iter([batch])))
    floors = np.array([want.filter(pa.compute.equal(want["query_id"], f"q{i}"))["score"].to_pylist()[-1] for i in range(5)])
    for given in (None, floors):
        got = pa.Table.from_batches(scoring._pruned_of(asked, 4, 0.0, given)(iter([batch])))
        assert got.equals(want)


def test_separation_rules_pairs_out(spark, monkeypatch):
    """Turns of users beyond a block of questions go by bounds, with the same row."""
    run = lambda: catalog.QUERIES["separation"](spark, "/root/testdata/sf0.001").collect()
    want, passes, pruned = run(), [], scoring._pruned_of
    monkeypatch.setattr(scoring, "QUESTIONS", 10)
    monkeypatch.setattr(scoring, "_pruned_of", lambda *a: passes.append(a) or pruned(*a))
    assert run() == want and len(passes) == 2  # the first look, and all chunks
