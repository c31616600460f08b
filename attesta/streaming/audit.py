"""Audit lines, recorded exactly once; and, as an extension, audit events counted as they come."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Spool files that one batch takes at most.
FILES = 10_000
_DONE, _BATCH = "_SUCCESS", "batch-"


def note(spool: str, event: dict) -> None:
    """Puts an event's line into the spool, under its request_id: no job, and put twice it is one."""
    line = json.dumps(event, sort_keys=True, ensure_ascii=False)
    Store(spool).write(f"{event['request_id']}.json", f"{line}\n".encode())


def spooled(spark: SparkSession, spool: str, files: int = FILES) -> DataFrame:
    """The lines of the spool's files as a stream, as they stand; files whose names begin with a dot are
    not there yet."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(spool)


def keep_batch(batch: DataFrame, number: int, log: str) -> None:
    """Writes a batch of lines into its own folder of the log. One that is there whole is left as it
    is, one that a failure left half is written again: a batch that comes twice adds nothing. Small
    tasks are put together, so a batch is few files of many lines."""
    name = f"{_BATCH}{number:012d}"
    if Store(log).size(f"{name}/{_DONE}") is None:
        batch.select("value").hint("rebalance").write.mode("overwrite").text(f"{log}/{name}")


def record(spark: SparkSession, spool: str, log: str, files: int = FILES, follow: bool = False) -> StreamingQuery:
    """Moves lines from the spool into the log: what is there by now, or with follow all that comes. The
    log holds the stream's own state, so a session that ends anywhere is gone on with by the next, which
    repeats the batch that wasn't finished and no other."""

    def keep(batch: DataFrame, number: int) -> None:
        keep_batch(batch, number, log)

    lines = spooled(spark, spool, files).writeStream.foreachBatch(keep).option("checkpointLocation", f"{log}/_state")
    return (lines.trigger(processingTime="10 seconds") if follow else lines.trigger(availableNow=True)).start()


def recorded(spark: SparkSession, log: str) -> DataFrame:
    """(value) the lines of all whole batches of a log."""
    store = Store(log)
    whole = [f"{log}/{n}" for n in store.folders() if n.startswith(_BATCH) and store.size(f"{n}/{_DONE}") is not None]
    return spark.read.text(whole) if whole else spark.createDataFrame([], "value string")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*").parquet(path)


def counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and errors per window and type; state is dropped once the watermark passes."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
