import os
import random

import pyarrow as pa
import pytest

from attesta.llm import common


def test_tables_are_written_and_deleted(spark):
    df = common.materialize(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    common.release(df)
    assert not os.path.exists(path)
    kept = common.materialize(spark.range(3).filter("id > 9"), "none")
    assert kept.count() == 0 and kept.dtypes == [("id", "bigint")]
    common.cleanup(spark)
    assert not os.path.exists(kept.inputFiles()[0].removeprefix("file://"))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    edges += [(500, 500 + i) for i in range(1, 80)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)


def test_no_edges(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_a_sorted_stream():
    keys = [1, 1, 2, 3, 3, 3, 3, 9]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 3]}) for i in range(0, 8, 3)]
    assert [g["k"].to_pylist() for g in common.sorted_groups(batches, "k")] == [[1, 1], [2], [3] * 4, [9]]
