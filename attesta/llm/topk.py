"""Exact inner-product search with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrices, rows_of

SAMPLE = 4096
PIVOTS = 256
#: Rows of a cell, the unit of search, and of a block of an annulus in it; queries that meet a cell
#: in one task.
CELL, ANNULUS, QUERIES = 4096, 256, 8192
_QUANTILES = 20
#: Below any score. Vectors whose square reaches its size could have scores that a long can't hold.
_LEAST = -(2**62)
_OUT = "name long, vec_id long, score long"


def exact_topk(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product of
    floor(scale * x), ties to the smaller id, the query's own row left out.

    One more component makes all vectors equally long, so that the largest product is the smallest
    distance. Rows are keyed by their nearest pivot and the distance to it, cut into annuli. Each
    query searches first the annulus with the best bound; then those whose bound, by the triangle
    inequality, reaches its k-th score, block by block in the order of their bounds. Pivots come
    from a sample of SAMPLE rows; every row is indexed and the bounds make the search exact. Large
    annuli are dealt over cells by id; a cell that more than QUERIES queries aim at is copied once
    for each so many, others not at all.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those
    whose integer square reaches 2**62, as a long could not hold their scores. Vectors of several
    lengths are searched by length. Rows that share an id are candidates and queries of their own:
    each gets its k rows, so a query id may stand several times. Null ids take no part. An empty
    table gives no rows; other columns are ignored."""
    spark = df.sparkSession
    raw = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), is_query.alias("q")
    ).filter("id is not null and x is not null")
    lengths = sorted(r[0] for r in raw.groupBy(F.size("x")).count().collect() if r[0] > 0)
    found = [_topk(raw.filter(F.size("x") == n), k, scale) for n in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _topk(raw: DataFrame, k: int, scale: float) -> DataFrame:
    """exact_topk() over vectors of one length."""
    spark = raw.sparkSession

    def quantize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in matrices(b.column(1)):
                v = np.floor(scale * x)
                n2 = (v * v).sum(axis=1)
                fit = n2 < -_LEAST
                own = b.take(pa.array(at[fit]))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0),
                        own.column(2),
                        pa.array([r.tobytes() for r in v[fit].astype("<i8")], pa.binary()),
                        pa.array(n2[fit]),
                    ],
                    ["id", "q", "v", "n2"],
                )

    rows = materialize(raw.mapInArrow(quantize, "id long, q boolean, v binary, n2 double"), "ints")
    total = rows.agg(F.count("*").alias("n"), F.max("n2").alias("m")).first()
    n, top = total["n"], total["m"] or 0.0
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a row goes by its id; where ids repeat, by id, vector and number of the copy, of which no
    # query needs more than k besides itself
    repeated = rows.groupBy("id").count().filter("count > 1").limit(1).count() > 0
    rows = rows.withColumns({"name": F.col("id"), "many": F.lit(1).cast("long"), "first": F.lit(True)})
    if repeated:
        each = rows.groupBy("id", "v").agg(F.bool_or("q").alias("q"), F.count("*").alias("many"))
        copies = F.explode(F.sequence(F.lit(0), F.least("many", F.lit(k + 1)).cast("int") - 1))
        rows = materialize(
            each.select("*", copies.alias("copy")).select(
                "id", "q", "v", F.xxhash64("id", "v", "copy").alias("name"), "many", (F.col("copy") == 0).alias("first")
            ),
            "copies",
        )

    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    sample = _lifted(np.array([np.frombuffer(r["v"], "<i8") for r in drawn], np.float64), top)
    pivots = _pivots(sample, max(1, min(PIVOTS, round(n**0.5 / 8), len(sample))))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, r = [], []
            for s in range(0, b.num_rows, 4096):
                d = _distances(_lifted(rows_of(b.column(1).slice(s, 4096), "<i8").astype(float), top), pivots)
                at.append(d.argmin(axis=1))
                r.append(d.min(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(r))],
                ["id", "v", "q", "name", "many", "pivot", "r"],
            )

    index = materialize(
        rows.select("id", "v", (F.col("q") & F.col("first")).alias("q"), "name", "many").mapInArrow(
            key, "id long, v binary, q boolean, name long, many long, pivot int, r double"
        ),
        "index",
    )
    cuts = [i / _QUANTILES for i in range(1, _QUANTILES)]
    per = index.groupBy("pivot").agg(
        F.count("*").alias("n"), F.percentile_approx("r", cuts, 1000).alias("cuts")
    ).collect()  # a row per pivot
    edges = {
        p["pivot"]: sorted({
            p["cuts"][i * _QUANTILES // rings - 1]
            for rings in [max(1, min(_QUANTILES, -(-p["n"] // CELL)))]
            for i in range(1, rings)
        })
        for p in per
    }
    ring = F.lit(0)
    for p, at in edges.items():
        if at:
            above = sum((F.col("r") > e).cast("int") for e in at)
            ring = F.when(F.col("pivot") == p, above).otherwise(ring)
    index = index.withColumn("ring", ring.cast("int"))
    stats = index.groupBy("pivot", "ring").agg(
        F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")
    ).orderBy("pivot", "ring").collect()  # at most PIVOTS * _QUANTILES rows
    s_pivot = np.array([s["pivot"] for s in stats])
    s_lo, s_hi = (np.array([s[c] for s in stats]) for c in ("lo", "hi"))
    salts = {(s["pivot"], s["ring"]): -(-s["n"] // (4 * CELL)) for s in stats}
    known = spark.createDataFrame(
        [(s["pivot"], s["ring"], i, salts[s["pivot"], s["ring"]]) for i, s in enumerate(stats)],
        "pivot int, ring int, cell int, salts long",
    )
    index = index.join(F.broadcast(known), ["pivot", "ring"]).withColumn(
        "salt", F.pmod(F.xxhash64("id"), "salts").cast("int")
    )
    asked = index.filter("q").select("name", "v")

    def aim(first: bool, tally: bool = False):
        """Queries with the cells that they search: the best one first, then the others that may hold
        a score of theirs. tally: only how many each cell gets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 2048):
                    b = big.slice(at, 2048)
                    q = rows_of(b.column(1), "<i8").astype(float)
                    n2 = (q * q).sum(axis=1)
                    d = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots)
                    bound = _bound(d[:, s_pivot], s_lo, s_hi, n2[:, None], top)
                    best = bound.argmax(axis=1)
                    if first:
                        i, cell = np.arange(len(q)), best
                        least = np.full(len(q), _LEAST, np.int64)
                    else:
                        need = bound >= b.column(2).to_numpy()[:, None]
                        need[np.arange(len(q)), best] = False
                        i, cell = np.nonzero(need)
                        least = b.column(2).to_numpy()[i]
                    if tally:
                        own, many = np.unique(cell, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(many)], ["cell", "n"])
                    else:
                        part = b.take(pa.array(i))
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0), part.column(1), pa.array(least), pa.array(cell.astype(np.int32))],
                            ["name", "v", "least", "cell"],
                        )

        return run

    def search(cell: pa.Table, queries: pa.Table) -> pa.Table:
        return _search(cell, queries, pivots, top, k)

    def look(queries: DataFrame, first: bool) -> DataFrame:
        """Every aimed query meets all cells of its annulus."""
        sums = queries.mapInArrow(aim(first, True), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        wanted = {r["cell"]: -(-r["n"] // QUERIES) for r in sums.collect()}  # a row per annulus at most
        if not wanted:
            return spark.createDataFrame([], _OUT)
        shares = spark.createDataFrame(
            [(i, s, wanted[i]) for i, s in enumerate(salts[p["pivot"], p["ring"]] for p in stats) if i in wanted],
            "cell int, salts long, blocks long",
        )
        salted = queries.mapInArrow(aim(first), "name long, v binary, least long, cell int").join(F.broadcast(shares), "cell").select(
            "name", "v", "least", "cell",
            F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"),
            F.pmod(F.xxhash64("name"), "blocks").cast("int").alias("block"),
        )
        cells = index.join(F.broadcast(shares.select("cell", "blocks")), "cell").select(
            "id", "name", "v", "r", "pivot", "cell", "salt",
            F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"),
        )
        on = ["cell", "salt", "block"]
        return cells.groupBy(*on).cogroup(salted.groupBy(*on)).applyInArrow(search, _OUT)

    first = materialize(look(asked, True), "first")
    best = W.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    reached = (
        first.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k)
        .select("name", F.col("score").alias("least"))
    )
    again = materialize(
        asked.join(reached, "name", "left").select("name", "v", F.coalesce("least", F.lit(_LEAST)).alias("least")),
        "again",
    )
    out = (
        first.unionByName(look(again, False))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )
    if not repeated:
        return out.select(F.col("name").alias("query_id"), "rank", "vec_id", "score")
    rows_of_query = index.filter("q").select("name", F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), "many")).alias("_"))
    return out.join(rows_of_query, "name").select("query_id", "rank", "vec_id", "score")


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0.0, d))


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Spread-out rows, each the farthest of a few drawn ones from those before, then moved to the
    means of what is nearest."""
    rng = np.random.default_rng(5)
    chosen = [sample[0]]
    near = _distances(sample, sample[:1])[:, 0]
    for _ in range(count - 1):
        drawn = rng.integers(0, len(sample), 16)
        chosen.append(sample[drawn[near[drawn].argmax()]])
        near = np.minimum(near, _distances(sample, chosen[-1][None])[:, 0])
    pivots = np.array(chosen)
    for _ in range(4):
        own = _distances(sample, pivots).argmin(axis=1)
        for p in range(count):
            if (own == p).any():
                pivots[p] = sample[own == p].mean(axis=0)
    return pivots


def _bound(d, lo, hi, n2, top):
    """The largest inner product that a row at a distance of lo to hi from the pivot can have with a
    query at distance d, with room for rounding."""
    gap = np.maximum(0.0, np.maximum(d - hi, lo - d))
    room = 1.0 + 1e-6 * (n2 + top)
    return (n2 + top - gap * gap) / 2 + room


def _search(cell: pa.Table, queries: pa.Table, pivots: np.ndarray, top: float, k: int) -> pa.Table:
    empty = {"name": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
    if not cell.num_rows or not queries.num_rows:
        return pa.table(empty)
    cell = cell.sort_by("r")
    x = rows_of(cell["v"].combine_chunks(), "<i8")
    ids, names, r = cell["id"].to_numpy(), cell["name"].to_numpy(), cell["r"].to_numpy()
    pivot = pivots[cell["pivot"][0].as_py()]
    q = rows_of(queries["v"].combine_chunks(), "<i8")
    qid, least = queries["name"].to_numpy(), queries["least"].to_numpy().copy()
    exact = float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2**53
    xs, qs = (x.astype(float), q.astype(float)) if exact else (x, q)
    n2 = (q.astype(float) ** 2).sum(axis=1)
    d = _distances(np.concatenate([q.astype(float), np.zeros((len(q), 1))], axis=1), pivot[None])[:, 0]
    starts = np.arange(0, len(ids), ANNULUS)
    ends = np.minimum(starts + ANNULUS, len(ids))
    bounds = _bound(d[:, None], r[starts], r[ends - 1], n2[:, None], top)
    best = np.full((len(q), k), _LEAST, np.int64)
    out = []
    for b in np.argsort(-bounds.max(axis=0), kind="stable"):
        who = np.flatnonzero(bounds[:, b] >= least)
        part = slice(starts[b], ends[b])
        for at in range(0, len(who), 1024):
            some = who[at : at + 1024]
            scores = (qs[some] @ xs[part].T).astype(np.int64)
            keep = scores >= least[some][:, None]
            keep &= qid[some][:, None] != names[part][None]
            i, j = np.nonzero(keep)
            out.append((some[i], ids[part][j], scores[i, j]))
            both = np.concatenate([best[some], np.where(keep, scores, _LEAST)], axis=1)
            best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[some] = np.maximum(least[some], best[some].min(axis=1))
    if not out:
        return pa.table(empty)
    i, v, s = (np.concatenate(c) for c in zip(*out))
    keep = s >= least[i]
    i, v, s = i[keep], v[keep], s[keep]
    order = np.lexsort((v, -s, i))
    i, v, s = i[order], v[order], s[order]
    first = np.concatenate([[True], i[1:] != i[:-1]])
    place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
    keep = place < k
    return pa.table({"name": qid[i[keep]], "vec_id": v[keep], "score": s[keep]})


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(rows, F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
