"""Vectors of queries against vectors of items, as products of blocks. No pair is a row on its way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries of one pass over the items; entries of a block of scores.
QUERIES, ENTRIES = 4096, 1 << 20
#: Groups of tasks whose best rows are merged before all meet.
GROUPS = 64
#: A product of blocks may differ by so much, relative to the vectors' lengths, from a sum in order.
SLACK = 1e-9


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length among the vectors that have an id and only finite components."""
    if isinstance(vectors, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    values = np.asarray(vectors.flatten().fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(lengths)
    known = np.asarray(ids.is_valid()) & (lengths > 0)
    for dim in np.unique(lengths[known]).tolist():
        rows = np.flatnonzero(known & (lengths == dim))
        x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
        finite = np.isfinite(x).all(axis=1)
        if finite.any():
            yield np.array(ids.take(pa.array(rows[finite])).to_pylist()), x[finite]


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the last axis, in order, so that a pair's sum is the same in any block."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        total += a[..., d] * b[..., d]
    return total


def _cosines(dots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(_summed(a, a)) * np.sqrt(_summed(b, b))
    return np.divide(dots, size, out=np.full(dots.shape, np.nan), where=size > 0)


def _passes(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries by length of vector, at most about QUERIES at a time."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = lambda table: {x.shape[1]: (ids, x) for ids, x in _by_length(table["query_id"], table["vector"])}
    first = asked.limit(QUERIES + 1).toArrow()
    if first.num_rows <= QUERIES:
        yield blocks(first)
        return
    passes = -(-asked.count() // QUERIES)
    for k in range(passes):
        yield blocks(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).toArrow())


def _run(queries: DataFrame, rows: DataFrame, task: Callable, extra: str = "") -> DataFrame:
    """The union of all passes of task(asked)(batches of item_id and vector)."""
    kinds = [queries.schema["query_id"].dataType, rows.schema["item_id"].dataType]
    schema = f"query_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, score double{extra}"
    items = rows.select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    types = [to_arrow_type(k) for k in kinds]
    found = None
    for asked in _passes(queries):
        part = items.mapInArrow(task(asked, types), schema)
        found = part if found is None else found.unionByName(part)
    return items.sparkSession.createDataFrame([], schema) if found is None else found


def scores(queries: DataFrame, rows: DataFrame, first: int | None = None) -> DataFrame:
    """(query_id, item_id, score): the cosine of every query(query_id, vector) with every
    row(item_id, vector), the full matrix. first: instead, the product of so many first components.

    Queries are brought to the tasks in blocks of at most about QUERIES, each one pass over the items.
    Vectors of other lengths, without a direction, with null or non-finite components or without an id
    score with nothing."""

    def task(asked, types):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x in _by_length(batch.column(0), batch.column(1)):
                    if x.shape[1] not in asked:
                        continue
                    names, q = asked[x.shape[1]]
                    step = max(1, ENTRIES // len(q))
                    for at in range(0, len(x), step):
                        a, b = q[:, None, :first], x[None, at : at + step, :first]
                        s = _summed(a, b)
                        s = _cosines(s, a, b) if first is None else s
                        i, j = np.nonzero(~np.isnan(s))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[i].tolist(), types[0]), pa.array(ids[at + j].tolist(), types[1]), pa.array(s[i, j])],
                            ["query_id", "item_id", "score"],
                        )

        return run

    return _run(queries, rows, task)


class _Best:
    """The k best items of each query so far: by score, then by id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.q, self.s, self.i = np.empty(0, np.int64), np.empty(0), None

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        q, s = np.concatenate([self.q, q]), np.concatenate([self.s, s])
        ids = ids if self.i is None else np.concatenate([self.i, ids])
        order = np.lexsort((ids, -s, q))
        q, s, ids = q[order], s[order], ids[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        self.floor[q[place == self.k - 1]] = s[place == self.k - 1]
        keep = place < self.k
        self.q, self.s, self.i = q[keep], s[keep], ids[keep]


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of largest cosine for each query, ties to the
    smaller id. Same vectors as in scores().

    A task multiplies blocks of queries and items, looks only at entries that may be among a query's k
    best so far, sums these again in order, and passes on k rows for each query. These are merged in
    groups of tasks, then all together."""
    from .ranking import best

    def task(asked, types):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units = {d: q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) for d, (_, q) in asked.items()}
            held = {d: _Best(len(q), k) for d, (_, q) in asked.items()}
            for batch in batches:
                for ids, x in _by_length(batch.column(0), batch.column(1)):
                    dim = x.shape[1]
                    if dim not in asked:
                        continue
                    q, best_ = asked[dim][1], held[dim]
                    step = max(1, ENTRIES // len(q))
                    for at in range(0, len(x), step):
                        part = x[at : at + step]
                        near = units[dim] @ (part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-300)).T
                        floor = best_.floor
                        if near.shape[1] > k:
                            floor = np.maximum(floor, np.partition(near, -k, axis=1)[:, -k] - SLACK)
                        i, j = np.nonzero(near >= floor[:, None] - SLACK)
                        for c in range(0, len(i), ENTRIES // 8):
                            a, b = i[c : c + ENTRIES // 8], j[c : c + ENTRIES // 8]
                            s = _cosines(_summed(q[a], part[b]), q[a], part[b])
                            some = ~np.isnan(s)
                            best_.add(a[some], s[some], ids[at + b[some]])
            group = TaskContext.get().partitionId() % GROUPS
            for d, b in held.items():
                if len(b.q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked[d][0][b.q].tolist(), types[0]), pa.array(b.i.tolist(), types[1]), pa.array(b.s), pa.array(np.full(len(b.q), group, np.int32))],
                        ["query_id", "item_id", "score", "_group"],
                    )

        return run

    found = _run(queries, rows, task, ", _group int")
    return best(best(found, k, "_group").drop("rank", "_group"), k)
