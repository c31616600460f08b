"""Checks of a controlled corpus. A corpus with an issue is not indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, once, resolved_path, source_hash
from ..vocabulary import DOC_TYPES, OUTSIDE, RETRIEVABLE, STATUSES, TWO_CURRENT

HASH = r"\Asha256:[a-f0-9]{64}\z"
ISO_DATE = r"\A\d{4}-\d{2}-\d{2}\z"


class CorpusInvalid(Exception):
    """A corpus with issues; they are listed in .issues."""

    def __init__(self, issues: list):
        super().__init__("; ".join(f"{i['path']}: {i['message']}" for i in issues))
        self.issues = issues


def metadata_problem() -> Column:
    """The first rule that a row of metadata breaks, or null: blank required text, unknown status
    or type, malformed hash or date, a review date before the effective date."""
    problem = F.when(F.lit(False), F.lit(""))
    for field in ("doc_id", "doc_title", "version", "department"):
        problem = problem.when(is_blank(F.col(field)), F.lit(f"{field}: must not be blank"))
    date = lambda c: F.try_to_date(F.when(F.col(c).cast("string").rlike(ISO_DATE), F.col(c).cast("string")))
    return (
        problem.when(~F.coalesce(F.col("doc_type").isin(*DOC_TYPES), F.lit(False)), "doc_type: unknown value")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status: unknown value")
        .when(~F.coalesce(F.col("source_hash").rlike(HASH), F.lit(False)), "source_hash: must be sha256 and 64 hex digits")
        .when(date("effective_date").isNull(), "effective_date: must be a date")
        .when(
            F.col("review_due_date").isNotNull() & date("review_due_date").isNull(),
            "review_due_date: must be a date",
        )
        .when(
            date("review_due_date") < date("effective_date"),
            "review_due_date: must not be before effective_date",
        )
    )


def duplicate_current(documents: DataFrame) -> DataFrame:
    """(doc_id, n_versions, versions) of ids with more than one retrievable version."""
    return (
        documents.filter(F.col("status").isin(*RETRIEVABLE)).groupBy("doc_id")
        .agg(F.count("*").alias("n_versions"), F.array_join(F.sort_array(F.collect_list("version")), ", ").alias("versions"))
        .filter("n_versions > 1")
    )


def check(sidecars: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, issues). sidecars: sidecar_path, parse_problem, inside and the metadata fields;
    files: path without dots, content. Without files, sidecars have the content of their sources.
    A source is the file that its path resolves to, wherever below the corpus that is.

    The first failing check of a sidecar is its issue: unreadable or against the schema, a source
    outside the corpus, missing, with another hash, or without text. Duplicate current versions are
    issues of their ids; their documents still count as valid."""
    at = sidecars
    if files is not None:
        place = resolved_path(F.col("source_file_path"))
        at = once(at, _place=place).withColumn("inside", F.col("inside") & F.col("_place").isNotNull())
        at = at.join(files.select(F.col("path").alias("_place"), "content"), "_place", "left").drop("_place")
    # text that isn't UTF-8 is an issue here, not an error of the job
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.decode("content", "UTF-8"))
    problem = (
        F.when(F.col("parse_problem").isNotNull(), F.col("parse_problem"))
        .when(metadata_problem().isNotNull(), metadata_problem())
        .when(~F.col("inside"), OUTSIDE)
        .when(F.col("content").isNull(), F.concat(F.lit("source file not found: "), "source_file_path"))
        .when(source_hash(F.col("content")) != F.col("source_hash"), "source_hash does not match source file content")
        .when(~utf8, "source file must be UTF-8")
        .when(is_blank(text), "source file must not be empty")
    )
    at = at.withColumn("problem", problem).withColumn("raw_text", text)
    empty = F.col("problem") == "source file must not be empty"
    issues = at.filter("problem is not null").select(
        F.when(empty, F.col("source_file_path")).otherwise(F.col("sidecar_path")).alias("path"),
        F.col("problem").alias("message"),
    )
    documents = at.filter("problem is null").drop("problem", "parse_problem", "inside", "content")
    twice = duplicate_current(documents).select(
        F.col("doc_id").alias("path"),
        F.format_string(
            TWO_CURRENT, "doc_id", "versions"
        ).alias("message"),
    )
    return documents, issues.unionByName(twice)


def ingest_report(seen: int | Column, documents: DataFrame) -> DataFrame:
    """One row of counts."""
    gate = F.col("status").isin(*RETRIEVABLE)
    return documents.agg(
        F.lit(seen).cast("long").alias("metadata_files_seen") if isinstance(seen, int) else seen.alias("metadata_files_seen"),
        F.count("*").alias("documents_valid"),
        F.count_if(gate).alias("documents_retrievable"),
        F.count_if(~gate).alias("documents_excluded"),
    )


def require_valid(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """documents, or CorpusInvalid with the issues (at most 100 are brought to the driver)."""
    found = issues.orderBy("path", "message").limit(100).collect()
    if found:
        raise CorpusInvalid(found)
    return documents
