"""The driver's tables as a controlled corpus. Metadata they lack follows from the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def controlled_documents(docs: DataFrame) -> DataFrame:
    """documents with doc_id, title, type, version, status, department, dates, path, hash and a body
    of a heading and paragraphs: each line of the text is one."""
    n = F.col("doc_id")
    status = (
        F.when(n % 10 == 0, "Draft").when(n % 10 == 1, "Obsolete").when(n % 10 == 2, "Superseded")
        .when(n % 10 <= 5, "Effective").otherwise("Approved")
    )
    text = F.coalesce("text", F.lit(""))
    body = F.concat(F.lit("# Section "), F.col("lang"), F.lit("\n\n"), F.replace(text, F.lit("\n"), F.lit("\n\n")))
    kind = F.when(n % 4 == 0, "SOP").when(n % 4 == 1, "Policy").when(n % 4 == 2, "Specification").otherwise("TechnicalNote")
    return docs.select(
        F.format_string("DOC-%06d", n).alias("doc_id"),
        F.concat(F.lit("Title "), F.col("lang"), F.lit(" "), n.cast("string")).alias("doc_title"),
        kind.alias("doc_type"),
        F.concat(F.lit("1."), (n % 3).cast("string")).alias("version"),
        status.alias("status"),
        F.col("source").alias("department"),
        F.concat(F.lit("documents/"), n.cast("string"), F.lit(".md")).alias("source_file_path"),
        F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256)).alias("source_hash"),
        body.alias("raw_text"),
        n.alias("doc_number"),
        F.format_string("FAM-%03d", n % 97).alias("family"),
        F.format_string("2024-%02d-%02d", n % 12 + 1, n % 28 + 1).alias("effective_date"),
        F.when(n % 7 == 0, F.format_string("20%02d-01-15", F.lit(23) + n % 4)).alias("review_due_date"),
    )


def questions(benchmark: DataFrame) -> DataFrame:
    """benchmark as query_id and question."""
    return benchmark.select(
        F.format_string("Q-%05d", F.col("item_id")).alias("query_id"), F.col("text").alias("question"), "item_id"
    )


def conversation_questions(conversations: DataFrame) -> DataFrame:
    """Turns of users as queries."""
    return conversations.filter("role = 'user'").select(
        F.format_string("C-%05d-%03d", "conv_id", "turn").alias("query_id"), F.col("text").alias("question")
    )
