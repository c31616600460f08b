"""Rankings and products of vectors against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import products, ranking


def fold(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def cosine(a, b):
    size = math.sqrt(fold(a, a)) * math.sqrt(fold(b, b))
    return fold(a, b) / size if size > 0 else None


def vectors(seed, n, dim=6, values=None):
    r = random.Random(seed)
    return [[r.choice(values) if values else r.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


def frames(spark, queries, items, kind="long"):
    q = spark.createDataFrame(queries, f"query_id {kind}, vector array<double>")
    return q, spark.createDataFrame(items, f"item_id {kind}, vector array<double>").repartition(5)


ODD = [None, [], [0.0] * 6, [1.0] * 5, [float("nan")] * 6, [None] + [1.0] * 5, [float("inf")] * 6]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("values", [None, (-1.0, 0.0, 1.0)])
def test_topk_against_all_pairs(spark, monkeypatch, values):
    """Ties (few values), vectors that score with nothing, several passes and blocks."""
    monkeypatch.setattr(products, "QUERIES", 7)
    monkeypatch.setattr(products, "ENTRIES", 64)
    queries = [(i, v) for i, v in enumerate(vectors(1, 20, values=values) + ODD)]
    items = [(i, v) for i, v in enumerate(vectors(2, 300, values=values) + ODD)] + [(None, [1.0] * 6)]
    items += [(10_000 + i, v) for i, v in items[:20]]
    q, x = frames(spark, queries, items)
    got = products.cosine_topk(q, x, 9)
    want = []
    for i, v in queries:
        usable = lambda u: u and len(u) == len(v or ()) and all(c is not None and math.isfinite(c) for c in u)
        own = [(cosine(v, u), j) for j, u in items if j is not None and usable(v) and usable(u)]
        own = sorted((-s, j) for s, j in own if s is not None)[:9]
        want += [(i, j, -s, k) for k, (s, j) in enumerate(own, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)


def test_scores_are_the_whole_matrix(spark, monkeypatch):
    monkeypatch.setattr(products, "ENTRIES", 16)
    queries = [(f"q{i}", v) for i, v in enumerate(vectors(3, 4) + ODD)]
    items = [(f"é{i}", v) for i, v in enumerate(vectors(4, 50) + ODD)]
    q, x = frames(spark, queries, items, "string")
    got = {(r["query_id"], r["item_id"]): r["score"] for r in products.scores(q, x).collect()}
    # of the odd vectors only the two of five components meet
    short = ("q7", "é53")
    assert got.pop(short) == pytest.approx(1.0)
    assert got == {(f"q{a}", f"é{b}"): cosine(queries[a][1], items[b][1]) for a in range(4) for b in range(50)}
    part = {(r["query_id"], r["item_id"]): r["score"] for r in products.scores(q, x, first=2).filter("query_id = 'q1'").collect()}
    assert part == {("q1", f"é{b}"): fold(queries[1][1][:2], items[b][1][:2]) for b in (*range(50), 52)}


def test_no_queries_or_items(spark):
    q, x = frames(spark, [(1, [1.0])], [(1, [1.0])])
    assert products.cosine_topk(q.limit(0), x, 3).collect() == [] == products.scores(q, x.limit(0)).collect()


def test_ranks_over_splits(spark, monkeypatch):
    """Scores of one value, of few and of all sizes: ranks are those of one sort, splits are even."""
    monkeypatch.setattr(ranking, "SPLIT_ROWS", 500)
    r = random.Random(5)
    make = [lambda: 0.25, lambda: r.choice([0.0, -3.5, 1e9]), lambda: 1 / (60 + r.randrange(10**6)), lambda: r.gauss(0, 1)]
    rows = [(q, i, make[q]()) for q in range(4) for i in range(10_000)] + [(9, 1, 0.5)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, score double").persist()
    want = {}
    for q in (0, 1, 2, 3, 9):
        own = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))
        want |= {(q, x[1]): k for k, x in enumerate(own, 1)}
    assert {(x["query_id"], x["item_id"]): x["rank"] for x in ranking.ranked(df).collect()} == want
    sizes = ranking.in_splits(df).filter("query_id < 4").groupBy("query_id", "_split").count()
    for x in sizes.groupBy("query_id").agg(F.max("count").alias("most"), F.median("count").alias("mid"), F.count("*").alias("n")).collect():
        assert x["n"] == 20 and x["most"] < 2 * x["mid"], x
    known = ranking.ranked(df.filter("query_id = 9"), most=1).collect()
    assert [x["rank"] for x in known] == [1]


def test_ranks_with_many_queries(spark, monkeypatch):
    """Sizes and splits that are joined, not sent to all tasks."""
    monkeypatch.setattr(ranking, "SPLIT_ROWS", 20)
    monkeypatch.setattr(ranking, "MANY", 3)
    rows = [(q, i, float(i * 7 % 100)) for q in range(10) for i in range(100)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, score double")
    got = {(x["query_id"], x["item_id"]): x["rank"] for x in ranking.ranked(df).collect()}
    assert got == {(q, i): 100 - i * 7 % 100 for q, i, _ in rows}
    assert ranking.ranked(df.limit(0)).collect() == []
