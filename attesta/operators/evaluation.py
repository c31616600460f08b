"""Suites of questions with known outcomes: one batched job per suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fraction
from ..vocabulary import RETRIEVABLE, RetrievalConfig
from .answers import extractive_answers, validate_citations
from .bm25 import Index, hits

_STRINGS = "array<string>"


def _lines(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def _one(when: Column, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(when, F.array(text)).otherwise(F.array().cast(_STRINGS))


def run_cases(index: Index, cases: DataFrame, config: RetrievalConfig) -> DataFrame:
    """One row of flags, observations and issues per case.

    cases: case_id, question, expected_outcome, top_k, expected_source_doc_ids, expected_chunk_ids,
    forbidden_doc_ids, expect_no_hits, fixture_outcome and fixture_citations (null without a
    fixture), expected_resolves, expected_issue_codes."""
    queries = cases.withColumn("query_id", F.col("case_id"))
    found = hits(index, queries, config)
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "status")))
    observed = found.groupBy("query_id").agg(listed.alias("_hits"))
    answers = validate_citations(extractive_answers(queries.select("query_id", "question"), found)).select(
        "query_id", F.when(F.col("valid"), F.col("outcome")).alias("generated_outcome"),
        F.col("valid").alias("generated_valid"), "retrieved", F.col("issue_codes").alias("generated_codes"),
    )
    at = queries.join(observed, "query_id", "left").join(answers, "query_id")
    of = lambda f: F.coalesce(F.transform("_hits", lambda h: h[f]), F.array().cast(_STRINGS))
    at = at.withColumns({"hit_chunk_ids": of("chunk_id"), "hit_doc_ids": of("doc_id"), "_statuses": of("status")})
    at = validate_citations(
        at.withColumns({
            "_cited": F.coalesce("fixture_citations", F.array()).cast("array<struct<chunk_id:string,label:string>>"),
            "_expected": F.coalesce("fixture_outcome", F.lit("refusal")),
        }),
        "_expected", "_cited", "retrieved",
    )
    fixture = F.col("fixture_outcome").isNotNull()
    codes = F.when(fixture, F.sort_array("issue_codes"))
    missing_docs = F.array_except("expected_source_doc_ids", "hit_doc_ids")
    missing_chunks = F.array_except("expected_chunk_ids", "hit_chunk_ids")
    forbidden = F.array_intersect("forbidden_doc_ids", "hit_doc_ids")
    stale = F.filter("_statuses", lambda s: ~s.isin(*RETRIEVABLE))
    empty = F.size("hit_chunk_ids") == 0
    unanswered = (F.col("expected_outcome") == "answer") & empty
    unexpected = F.col("expect_no_hits") & ~empty
    cited_well = F.when(
        fixture,
        (F.col("citation_resolves") == F.col("expected_resolves"))
        & (codes == F.sort_array(F.coalesce("expected_issue_codes", F.array().cast(_STRINGS)))),
    )
    # an answer whose own citations don't hold has no outcome
    told = F.coalesce(F.col("generated_outcome") == F.col("expected_outcome"), F.lit(False))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(c), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    said = lambda c: F.when(F.col(c), "True").otherwise("False")
    at = at.withColumns(
        {
            "retrieval_passed": (F.size(missing_docs) == 0) & (F.size(missing_chunks) == 0) & ~unanswered,
            "stale_passed": (F.size(forbidden) == 0) & (F.size(stale) == 0),
            "refusal_passed": ~unexpected,
            "citation_passed": cited_well,
            "citation_resolves": F.when(fixture, F.col("citation_resolves")),
            "citation_issue_codes": codes,
            "outcome_passed": told,
            "issues": F.concat(
                _lines("expected_source_doc_missing:", missing_docs),
                _lines("expected_chunk_missing:", missing_chunks),
                _lines("forbidden_doc_retrieved:", forbidden),
                _lines("stale_status_retrieved:", stale),
                _one(unexpected, "expected_no_hits"),
                _one(unanswered, "answer_expected_but_no_hits"),
                _one(
                    ~F.coalesce(cited_well, F.lit(True)),
                    F.concat(
                        F.lit("citation_expectation_mismatch:expected_resolves="), said("expected_resolves"),
                        F.lit(",observed_resolves="), said("citation_resolves"),
                        F.lit(",expected_codes="), listed("expected_issue_codes"),
                        F.lit(",observed_codes="), listed("issue_codes"),
                    ),
                ),
                _one(
                    ~F.col("generated_valid"),
                    F.concat(F.lit("generated_answer_citation_validation_failed:"), F.array_join(F.sort_array("generated_codes"), ",")),
                ),
                _one(
                    F.col("generated_valid") & ~told,
                    F.concat(
                        F.lit("generated_answer_outcome_mismatch:expected="), "expected_outcome",
                        F.lit(",observed="), "generated_outcome",
                    ),
                ),
            ),
        }
    )
    passed = (
        F.col("retrieval_passed") & F.col("stale_passed") & F.col("refusal_passed")
        & F.col("outcome_passed") & F.col("generated_valid") & F.coalesce("citation_passed", F.lit(True))
    )
    return at.withColumn("passed", passed).select(
        "case_id", "passed", "expected_outcome", "hit_chunk_ids", "hit_doc_ids", "retrieval_passed",
        "stale_passed", "refusal_passed", "citation_passed", "citation_resolves",
        "citation_issue_codes", "generated_outcome", "outcome_passed",
        F.col("generated_valid").alias("generated_citation_passed"), "issues",
    )


#: metric: (flag that counts, condition on the case)
METRICS = {
    "case_pass_rate": ("passed", "true"),
    "retrieval_expectation_match_rate": ("retrieval_passed", "true"),
    "stale_document_exclusion_rate": ("stale_passed", "true"),
    "refusal_expectation_match_rate": ("refusal_passed", "expected_outcome = 'refusal'"),
    "citation_resolves_to_retrieved_chunk_rate": ("citation_resolves", "citation_resolves is not null"),
    "citation_expectation_match_rate": ("citation_passed", "citation_resolves is not null"),
    "generated_answer_outcome_match_rate": ("outcome_passed", "true"),
    "generated_answer_citation_validation_rate": ("generated_citation_passed", "true"),
}


def suite_metrics(results: DataFrame) -> DataFrame:
    """One row: the eight rates as 'n/d' (n/a without cases), case counts and whether all passed."""
    rates = [
        fraction(F.count_if(F.expr(where) & F.col(flag)), F.count_if(F.expr(where))).alias(name)
        for name, (flag, where) in METRICS.items()
    ]
    return results.agg(
        F.count("*").alias("cases_total"),
        F.count_if("passed").alias("cases_passed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
        *rates,
    )


def evaluate(index: Index, cases: DataFrame, config: RetrievalConfig | None = None):
    """(results, metrics) of a suite."""
    results = run_cases(index, cases, config or RetrievalConfig(top_k=3))
    return results, suite_metrics(results)
