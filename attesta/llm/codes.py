"""Vectors as codes: parts of a vector are replaced by the nearest entry of their codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, release
from .vectors import matrices, rows_of

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums of labels that are sent to all tasks; more are joined.
LABELS = 100_000
_TOTAL = "decimal(38,0)"


def largest(dim: int) -> int:
    """The largest component, as an integer, of vectors whose squared distances are surely longs."""
    return isqrt((1 << 60) // dim) // 2


def neighbours(book: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Squared distances between a codebook's entries, and for each entry the others, nearest first."""
    gaps = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    order = np.argsort(gaps, axis=1, kind="stable")
    return gaps, [row[row != a] for a, row in enumerate(order)]


def search(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry for each row of x, the first among equals.

    A row begins at the entry `start` and scans that entry's neighbours, nearest first. One that is
    as near to the row as the start is, or nearer, lies at most twice the row's distance from the
    start, so the scan ends there. All in integers: the squares are compared with four times."""
    gaps, others = neighbours(book)
    best = start.astype(np.int64)
    dist = ((x - book[best]) ** 2).sum(axis=1)
    reach = 4 * dist
    for a in np.unique(start).tolist():
        rows = np.flatnonzero(start == a)
        for j in others[a].tolist():
            rows = rows[reach[rows] >= gaps[a, j]]
            if not len(rows):
                break
            own, had = ((x[rows] - book[j]) ** 2).sum(axis=1), dist[rows]
            better = (own < had) | ((own == had) & (j < best[rows]))
            best[rows[better]], dist[rows[better]] = j, own[better]
    return best, dist


def _integers(id_col: str, scale: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in matrices(batch.column(2)):
                x = np.floor(values * scale)
                fit = (np.abs(x) <= largest(x.shape[1])).all(axis=1)
                rows, x = rows[fit], x[fit].astype("<i4")
                x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
                taken = batch.select([0, 1]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["_id", "_label", "dim", "v"],
                )

    return run


def _assigned(books: dict[int, np.ndarray], schema: pa.Schema, sums: bool) -> Callable:
    """Rows with their codes and errors; after the rows of a task, with sums, a row for each sum of
    a component, and for each count, over the parts that an entry has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {d: np.zeros((b.shape[0], b.shape[1], b.shape[2] + 1), np.int64) for d, b in books.items()}
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x = rows_of(own.column(3), "<i4").astype(np.int64)
                book = books[dim]
                width = book.shape[2]
                before = rows_of(own.column(4), np.uint8)
                codes, error = np.empty((len(x), len(book)), np.uint8), np.zeros(len(x), np.int64)
                for p, entries in enumerate(book):
                    part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    code, dist = search(part, entries, before[:, p].astype(np.int64))
                    codes[:, p] = code
                    error += dist
                    if sums:
                        for a in np.unique(code).tolist():
                            mine = part[code == a]
                            totals[dim][p, a, :width] += mine.sum(axis=0)
                            totals[dim][p, a, width] += len(mine)
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:4], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.decimal128(38))],
                    schema=schema,
                )
        for dim, total in totals.items() if sums else ():
            slots = np.flatnonzero(total.ravel()).astype(np.int32)
            n = len(slots)
            values = [Decimal(v) for v in total.ravel()[slots].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, schema.field(0).type), pa.nulls(n, schema.field(1).type), pa.array(np.full(n, dim, np.int32)),
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(slots),
                 pa.array(values, pa.decimal128(38))],
                schema=schema,
            )

    return run


def moved(books: dict[int, np.ndarray], sums: list) -> dict[int, np.ndarray]:
    """Codebooks whose entries are the floored means of their parts; those without parts stay."""
    out = {}
    for dim, book in books.items():
        parts, entries, width = book.shape
        total = [0] * (parts * entries * (width + 1))
        for r in sums:
            if r["dim"] == dim:
                total[r["slot"]] = int(r["total"])
        book = book.copy()
        for p in range(parts):
            for a in range(entries):
                at = (p * entries + a) * (width + 1)
                if count := total[at + width]:
                    book[p, a] = [s // count for s in total[at : at + width]]
        out[dim] = book
    return out


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(rows, codebooks). rows: id, label, dim, code (binary, an entry's index per part), error
    (squared distance, summed over parts). codebooks: for each length of vectors, the entries as
    (part, entry, position).

    A round is one pass over the integer vectors: each part looks for its entry from the one that it
    had, and each task adds the sums that move the entries, which Spark adds up; the driver gets one
    number per component of a codebook. A round's table, with vectors and codes, replaces the one
    before it in the shared folder, so a lost executor costs a part of one round. Sums are whole
    numbers: results don't depend on partitions.

    Null vectors, and ones that are empty or hold null or non-finite components, go; so do vectors
    with components beyond largest(), whose distances are no longs. Vectors of each length have
    codebooks of their own; a length that the parts don't divide is filled up with zeros. First
    entries are those of the smallest ids, null ids last, then in the order of the vectors' bytes;
    repeated rows count again. With fewer rows than entries there are as many entries as rows; an
    empty table gives no rows and no codebooks. Other columns are ignored."""
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    three = df.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").alias("_label"),
        F.col(f"`{vec_col}`").cast("array<double>").alias("v"),
    )
    label = three.schema["_label"].dataType.simpleString()
    schema = f"_id long, _label {label}, dim int, v binary"
    vectors = materialize(three.mapInArrow(lean(_integers(id_col, scale, parts)), schema), "vectors")
    books = {}
    for r in vectors.groupBy("dim").count().orderBy("dim").collect():  # a row per length
        first = vectors.filter(F.col("dim") == r["dim"]).orderBy(F.col("_id").asc_nulls_last(), "v").limit(entries)
        x = np.stack([np.frombuffer(f["v"], "<i4").astype(np.int64) for f in first.select("_id", "v").collect()])
        books[r["dim"]] = x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()
    # before the first round every part stands at entry 0
    at = vectors.select("*", F.lit(bytearray(parts)).alias("code"), F.lit(0).cast("long").alias("error"))
    made = vectors
    full = f"{schema}, code binary, error long, slot int, total {_TOTAL}"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(three.sparkSession.createDataFrame([], full).schema)
    for k in range(rounds + 1):
        last = k == rounds
        done = materialize(at.mapInArrow(lean(_assigned(books, arrow, not last)), full), "assigned")
        release(made)
        made = done
        if not last:
            sums = done.filter("slot is not null").groupBy("dim", "slot").agg(F.sum("total").alias("total"))
            books = moved(books, sums.collect())
        at = done.filter("slot is null").select("_id", "_label", "dim", "v", "code", "error")
    rows = at.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "dim", "code", "error")
    return rows, books


def decoded(code: bytes, book: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([entries[c] for entries, c in zip(book, code)])


def op11_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all rows of embeddings, see vector_codes(). label_error: errors of a label's rows
    together, null labels being one."""
    rows, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    kind = rows.schema["label"].dataType.simpleString()
    total = rows.groupBy("label").agg(F.sum(F.col("error").cast(_TOTAL)).cast("long").alias("label_error"))
    total = materialize(total, "labels")
    few = total.limit(LABELS + 1).collect()
    if len(few) <= LABELS:
        total = F.broadcast(spark.createDataFrame([tuple(r) for r in few], f"label {kind}, label_error long"))
    shas = spark.createDataFrame([(d, digest(b)) for d, b in books.items()], "dim int, codebooks_sha256 string")
    total = total.withColumnRenamed("label", "_of")
    return (
        rows.join(total, F.col("label").eqNullSafe(F.col("_of")))
        .join(F.broadcast(shas), "dim")  # a row per length of vectors
        .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")
    )


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    ctes = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, len(embedding) // {parts} AS width,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """comp AS MATERIALIZED (SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, v[i] AS x
  FROM (SELECT vec_id, width, v, unnest(range(1, len(v) + 1)) AS i FROM kept))""",
        f"""b0 AS MATERIALIZED (SELECT part, f.entry, pos, x FROM comp JOIN
  (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}) f USING (vec_id))""",
    ]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM
  (SELECT vec_id, part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN b{k} b USING (part, pos) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if k < rounds:
            ctes.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos,
    coalesce((s - ((s % n) + n) % n) // n, b.x) AS x FROM b{k} b LEFT JOIN
    (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM comp JOIN a{k} USING (vec_id, part) GROUP BY ALL) m
    USING (part, entry, pos))""")
    hexed = "format('{:02x}', entry)"
    return f"""WITH {", ".join(ctes)},
rows AS (SELECT vec_id, string_agg({hexed}, '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
labelled AS (SELECT vec_id, code, error, label FROM rows JOIN kept USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM labelled"""


ORACLE_SQL = _oracle()
