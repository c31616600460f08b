"""Extractive answers, the validation of their citations, and review routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import LOW_SCORE_REASON, REFUSAL_REASON, REFUSAL_TEXT, RETRIEVABLE

CITATIONS = "array<struct<chunk_id:string,label:string>>"
RETRIEVED = "array<struct<chunk_id:string,status:string>>"


class AnswerInvalid(Exception):
    """An assembled answer whose own citations don't hold."""


def extractive_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, question, outcome, answer_text, citations, retrieved) for every query: its hits
    quoted in the order of their ranks, each labelled and cited; without hits, a refusal."""
    block = F.format_string(
        "[source: %d] %s v%s, %s, %s\n%s",
        "rank", "doc_id", "version", "section_heading", "line_or_page_span", "text",
    )
    parts = F.array_sort(
        F.collect_list(F.struct("rank", block.alias("block"), "chunk_id", "status", "score"))
    )
    found = hits.groupBy("query_id").agg(parts.alias("parts"))
    answered = F.col("parts").isNotNull()
    return queries.join(found, "query_id", "left").select(
        "query_id",
        "question",
        F.when(answered, "answer").otherwise("refusal").alias("outcome"),
        F.when(answered, F.array_join(F.transform("parts", lambda p: p["block"]), "\n\n"))
        .otherwise(REFUSAL_TEXT)
        .alias("answer_text"),
        F.coalesce(
            F.transform(
                "parts",
                lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["rank"].cast("string").alias("label")),
            ),
            F.array(),
        ).cast(CITATIONS).alias("citations"),
        F.coalesce(
            F.transform("parts", lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["status"].alias("status"))),
            F.array(),
        ).cast(RETRIEVED).alias("retrieved"),
        F.element_at("parts", 1)["score"].alias("top_score"),
    )


def validate_citations(
    answers: DataFrame,
    outcome: str = "outcome",
    citations: str = "citations",
    retrieved: str = "retrieved",
) -> DataFrame:
    """answers with citation_resolves, the counts of citations, retrieved and resolved chunks, issue_codes in
    their order, and valid.

    Issues: a retrieved chunk that is stale, each; an answer without citations; a refusal with
    some; then, by citation, one that resolves to nothing, or to a stale chunk (which does
    resolve). Of retrieved chunks with one id the last counts. It never reads the answer's text."""
    got, cited = F.col(retrieved), F.col(citations)
    fresh = F.array(*map(F.lit, RETRIEVABLE))
    stale = lambda h: ~F.coalesce(F.array_contains(fresh, h["status"]), F.lit(False))
    of = lambda c: F.filter(got, lambda h: h["chunk_id"] == c["chunk_id"])
    code = lambda c: (
        F.when(F.size(of(c)) == 0, F.lit("unresolved_citation"))
        .when(stale(F.element_at(of(c), -1)), F.lit("stale_citation"))
    )
    missing = (F.col(outcome) == "answer") & (F.size(cited) == 0)
    issues = F.concat(
        F.transform(F.filter(got, stale), lambda h: F.lit("stale_retrieved_chunk")),
        F.when(missing, F.array(F.lit("missing_answer_citation"))).otherwise(F.array().cast("array<string>")),
        F.when((F.col(outcome) == "refusal") & (F.size(cited) > 0), F.array(F.lit("refusal_has_citation")))
        .otherwise(F.array().cast("array<string>")),
        F.filter(F.transform(cited, code), lambda x: x.isNotNull()),
    )
    resolved = F.size(F.filter(cited, lambda c: F.size(of(c)) > 0))
    at = answers.withColumns(
        {
            "answer_citation_count": F.size(cited),
            "retrieved_chunk_count": F.size(got),
            "resolved_citation_count": resolved,
            "issue_codes": issues,
            "citation_resolves": (resolved == F.size(cited)) & ~missing,
        }
    )
    return at.withColumn("valid", F.col("citation_resolves") & (F.size("issue_codes") == 0))


def checked_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Answers with their validation; raises at run time on one whose own citations don't hold."""
    at = validate_citations(extractive_answers(queries, hits))
    return at.withColumn(
        "valid",
        F.when(F.col("valid"), True).otherwise(
            F.raise_error(F.concat(F.lit("generated answer has invalid citations: "), "query_id")).cast("boolean")
        ),
    )


def review_reasons(outcome: Column, top_score: Column, score_floor: float, margin: float) -> Column:
    """A refusal, or else a best score of at most floor + margin, asks for review."""
    return (
        F.when(outcome == "refusal", F.array(F.lit(REFUSAL_REASON)))
        .when(top_score <= score_floor + margin, F.array(F.lit(LOW_SCORE_REASON)))
        .otherwise(F.array().cast("array<string>"))
    )


def route_review(answers: DataFrame, score_floor: float = 0.0, margin: float = 1.0) -> DataFrame:
    reasons = review_reasons(F.col("outcome"), F.col("top_score"), score_floor, margin)
    at = answers.withColumn("review_reasons", reasons)
    return at.withColumn("review_recommended", F.size("review_reasons") > 0)
