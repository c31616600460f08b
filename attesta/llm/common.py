"""Shared pieces of the training-data operators: tables in the shared folder, grouped Arrow
streams and distributed connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order key of rows without an id: they come after all others.
LAST = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, in local mode (tests) one is made and
    set; a cluster needs it, as executors don't see each other's folders."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="attesta-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


def row_key(df_id: str, df_text: str) -> Column:
    """64 bits that name a row's id and text together: rows of one id and different texts differ, and
    rows without an id differ by their texts. Equal rows are one."""
    return F.xxhash64(F.col(df_id).cast("long"), F.col(df_text).cast("string"))


def order_id(df_id: str) -> Column:
    """The id as an order key: rows without one come after all others."""
    return F.coalesce(F.col(df_id).cast("long"), F.lit(LAST))


_shipped: set[str] = set()
_made: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python code runs there
    whether or not the package is installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="attesta-")) / "attesta.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one, which cleanup() deletes."""
    folder = f"{shared_dir(spark)}/attesta-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lineage ends there."""
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Deletes the files of a table made by materialize() that nothing needs any more."""
    for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        for own in [m for m in _made if m.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]]:
            _delete(df.sparkSession, own)
            _made.remove(own)


def made() -> list[str]:
    """The folders that this process has made and not deleted yet."""
    return list(_made)


def cleanup(spark: SparkSession, but: list[str] | None = None) -> None:
    """Deletes the tables that this process has made in the shared folder, but for those named.
    Results that operators have returned read some of them, so these must have been written elsewhere
    before."""
    for folder in [m for m in _made if m not in (but or ())]:
        _delete(spark, folder)
        _made.remove(folder)


def size_estimate(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of df; for files, their size. No job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lean(run: Callable) -> Callable:
    """A function of batches that gives the memory it has freed back to the system when it ends.
    Workers outlive their tasks, and have little room beside an executor's heap."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return own


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in pieces that hold rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of rows with equal `key` (int64, not null) of a stream sorted by it. One group is
    held at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        for start, end in zip(starts.tolist(), ends.tolist()):
            piece = batch.slice(start, end - start)
            if held and held_key != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[start]
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i] for all i. labels[x] is the root of x; roots are minima."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (up := labels[labels] != labels).any():
            labels[up] = labels[labels[up]]
    return labels


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges(a, b); component is the smallest node reachable.

    Alternates large-star and small-star contraction. A hub's rows are joined to its minimum, not
    gathered, so adaptive execution can split them; each round ends in a table in the shared folder."""
    e = materialize(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, e = e, materialize(small, "edges")
        release(before)
        was, seen = seen, _mark(e)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    row = e.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return row["n"], row["x"]
