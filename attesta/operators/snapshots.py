"""An index that follows a corpus: only documents that came, went or changed are counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bm25 import Index, document_frequency, inverse_frequency, tokenized
from .chunking import chunk_documents, status_gate

#: What a document's chunks depend on. The hash stands for the text.
KEYED = ("doc_id", "doc_title", "doc_type", "version", "status", "department", "source_file_path", "source_hash")


def document_key() -> Column:
    """A name for a document as it is: another text, status or title makes another one."""
    return F.sha2(F.to_json(F.struct(*KEYED), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class Snapshot:
    """keys: (key, n), how often each document stands in the corpus; chunks: with tokens, length and the
    key of their document; df: (token, df); totals: (n_chunks, n_tokens), one row."""

    keys: DataFrame
    chunks: DataFrame
    df: DataFrame
    totals: DataFrame

    def index(self) -> Index:
        """The index of these chunks; the floor of idf follows from the counts of each df."""
        mean = F.try_divide(F.col("n_tokens"), F.col("n_chunks")).alias("avg_tokens")
        stats = self.totals.select("n_chunks", mean)
        return Index(self.chunks.drop("key"), stats, inverse_frequency(self.df, stats))

    def save(self, path: str) -> Snapshot:
        """Written as tables below path, and read from there."""
        spark = self.chunks.sparkSession
        for name in ("keys", "chunks", "df", "totals"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        return load(spark, path)


def load(spark: SparkSession, path: str) -> Snapshot:
    return Snapshot(*(spark.read.parquet(f"{path}/{name}") for name in ("keys", "chunks", "df", "totals")))


def _gated(documents: DataFrame, gate: bool) -> DataFrame:
    return (status_gate(documents) if gate else documents).withColumn("key", document_key())


def _counted(documents: DataFrame) -> DataFrame:
    return documents.groupBy("key").agg(F.count("*").alias("n"))


def _chunks(documents: DataFrame) -> DataFrame:
    return tokenized(chunk_documents(documents, gate=False)).withColumn("key", document_key())


def _totals(chunks: DataFrame, sign: int = 1) -> DataFrame:
    return chunks.agg((sign * F.count("*")).alias("n_chunks"), (sign * F.coalesce(F.sum("n_tokens"), F.lit(0))).alias("n_tokens"))


def take(documents: DataFrame, gate: bool = True) -> Snapshot:
    """The first snapshot of a corpus; all of it is counted."""
    rows = _gated(documents, gate)
    chunks = _chunks(rows)
    return Snapshot(_counted(rows), chunks, document_frequency(chunks), _totals(chunks))


def update(old: Snapshot, documents: DataFrame, gate: bool = True) -> Snapshot:
    """The snapshot of documents, by difference from old, which must be of the same gate.

    Documents are compared by their keys, and by how often each stands there. Only those that came are
    chunked and tokenised; of those that went, the stored chunks are subtracted. df, the number of
    chunks and their tokens are corrected by plus and minus, so the index equals a fresh one. Save it
    before the next update, as plans grow."""
    rows = _gated(documents, gate)
    keys = _counted(rows)
    both = keys.join(old.keys.withColumnRenamed("n", "_was"), "key", "full")
    changed = both.filter(~F.col("n").eqNullSafe(F.col("_was"))).select("key")
    gone = old.chunks.join(changed, "key", "left_semi")
    come = _chunks(rows.join(changed, "key", "left_semi"))
    df = (
        old.df.unionByName(document_frequency(come))
        .unionByName(document_frequency(gone).withColumn("df", -F.col("df")))
        .groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")
    )
    parts = old.totals.unionByName(_totals(come)).unionByName(_totals(gone, -1))
    totals = parts.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
    kept = old.chunks.join(changed, "key", "left_anti")
    return Snapshot(keys, kept.select(old.chunks.columns).unionByName(come), df, totals)
