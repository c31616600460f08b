"""Writers: normalised corpora, reports, audit lines, demo exports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import onboarding
from ..vocabulary import RETRIEVABLE
from . import corpora
from .bundles import BundleError, dump


def _store(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str, force: bool = False) -> None:
    """Makes room for output: an absent or empty folder is fine, one with contents only with force."""
    at, store = _store(spark, path)
    if store.exists(at) and len(store.listStatus(at)):
        if not force:
            raise BundleError(f"{path} exists and is not empty; pass force=True to replace it")
        store.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, store = _store(spark, path)
    out = store.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def normalized_corpus(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Emitted records as documents of a clean corpus: metadata, text and the hash of the copy."""
    text = sources.select("source_path", "raw_text")
    name = F.substring_index("source_path", "/", -1)
    return (
        records.filter(onboarding.should_emit(F.col("state"))).join(text, "source_path")
        .select(
            "doc_id", "doc_title", "doc_type", "version", F.col("canonical_status").alias("status"),
            "effective_date", "department", F.concat(F.lit("documents/"), name).alias("source_file_path"),
            F.concat(F.lit("sha256:"), F.sha2(F.col("raw_text").cast("binary"), 256)).alias("source_hash"),
            "raw_text", "source_path",
        )
    )


def write_normalized(documents: DataFrame, path: str, force: bool = False) -> None:
    """A clean corpus as a table. Nothing is written over unless force says so."""
    claim(documents.sparkSession, path, force)
    documents.write.mode("overwrite").parquet(path)


def metadata_paths(documents: DataFrame) -> DataFrame:
    """(source_path, emitted_metadata_path) of the documents of a clean corpus."""
    name = F.regexp_replace(F.substring_index("source_file_path", "/", -1), r"\.[^.]*\z", "")
    return documents.select("source_path", F.concat(F.lit("metadata/"), name, F.lit(".yaml")).alias("emitted_metadata_path"))


def write_bundle(documents: DataFrame, path: str, force: bool = False) -> dict[str, str]:
    """A clean corpus as Markdown files with YAML sidecars, for tools that read folders, written by the
    executors, see corpora.write(). The result, source path to metadata path, is for small bundles;
    metadata_paths() is the same as a table."""
    corpora.write(documents, path, force)
    return {r[0]: r[1] for r in metadata_paths(documents).orderBy("source_path").collect()}


def onboarding_report(
    records: DataFrame, bundle: str, hashes: dict[str, str] | None = None, written: DataFrame | None = None
) -> dict:
    """The report's aggregates and records, as a dict. Nulls are left out of records. hashes: of the
    mapping and the register; written: metadata path of each source that was emitted."""
    kept = records.drop("current_version")
    if written is not None:
        kept = kept.join(written, "source_path", "left")
    rows = [{k: v for k, v in r.asDict(True).items() if v is not None} for r in kept.orderBy("source_path").toLocalIterator()]
    return {
        "source_bundle": bundle,
        **(hashes or {}),
        "input_document_count": len(rows),
        "emitted_document_count": sum(r["state"] in ("mapped_cleanly", "excluded") for r in rows),
        "state_counts": {r["state"]: r["n"] for r in onboarding.state_counts(records).collect()},
        "field_coverage": {
            r["field"]: {"established": r["established"], "missing": r["missing"]}
            for r in onboarding.field_coverage(records).collect()
        },
        "canonical_status_counts": dict(sorted(map(tuple, onboarding.status_counts(records).collect()))),
        "unknown_status_values": sorted(r["value"] for r in onboarding.unknown_statuses(records).collect()),
        "records": rows,
    }


def markdown(title: str, sections: list[tuple[str, list[str]]]) -> str:
    lines = [f"# {title}", ""]
    for name, items in sections:
        lines += [f"## {name}", "", *(items or ["- none"]), ""]
    return "\n".join(lines)


def onboarding_markdown(report: dict) -> str:
    by_state = lambda s: [f"- `{r['source_path']}`: {', '.join(r['reasons']) or 'none'}" for r in report["records"] if r["state"] == s]
    return markdown(
        "Onboarding report",
        [
            ("Summary", [f"- Source bundle: `{report['source_bundle']}`", f"- Input documents: {report['input_document_count']}", f"- Emitted documents: {report['emitted_document_count']}"]),
            ("State counts", [f"- `{s}`: {n}" for s, n in report["state_counts"].items()]),
            ("Field coverage", [f"- `{f}`: {c['established']} established, {c['missing']} missing" for f, c in report["field_coverage"].items()]),
            ("Unknown status values", [f"- `{v}`" for v in report["unknown_status_values"]]),
            ("Records needing review", by_state("needs_review")),
            ("Rejected records", by_state("rejected")),
        ],
    )


#: A case's columns by their names in a report.
_CASE = {
    "case_id": "case_id", "passed": "passed", "expected_outcome": "expected_outcome", "hit_chunk_ids": "hit_chunk_ids",
    "hit_doc_ids": "hit_doc_ids", "retrieval_expectation_passed": "retrieval_passed",
    "stale_document_exclusion_passed": "stale_passed", "refusal_expectation_passed": "refusal_passed",
    "citation_expectation_passed": "citation_passed", "citation_resolves_to_retrieved_chunk": "citation_resolves",
    "citation_issue_codes": "citation_issue_codes", "generated_answer_outcome": "generated_outcome",
    "generated_answer_outcome_passed": "outcome_passed",
    "generated_answer_citation_validation_passed": "generated_citation_passed", "issues": "issues",
}


def evaluation_report(suite: str, summary: dict, config: dict, metrics: dict, results: list[dict]) -> dict:
    """A report in the order of its keys; metrics and results as evaluate() gives them."""
    metrics = dict(metrics)
    total, passed, valid = (metrics.pop(k) for k in ("cases_total", "cases_passed", "passed"))
    cases = [{name: r[own] for name, own in _CASE.items()} for r in results]
    for case in cases:
        case["citation_issue_codes"] = case["citation_issue_codes"] or []
    return {
        "valid": valid, "trust_layer_status": "pass" if valid else "fail", "suite_name": suite, "corpus_summary": summary,
        "retrieval_config": config, "case_count": total, "passed_case_count": passed, "metrics": metrics, "cases": cases,
    }


def evaluation_markdown(report: dict) -> str:
    summary, config = report["corpus_summary"], report["retrieval_config"]

    def row(case: dict) -> str:
        checked = "none" if case["citation_expectation_passed"] is not None else "n/a"
        cells = (
            f"`{case['case_id']}`", str(case["passed"]).lower(), case["generated_answer_outcome"] or "n/a",
            ", ".join(case["hit_chunk_ids"]) or "none", ", ".join(case["citation_issue_codes"]) or checked,
            str(case["generated_answer_citation_validation_passed"]).lower(), "; ".join(case["issues"]) or "none",
        )
        return f"| {' | '.join(cells)} |"

    table = [
        "| Case | Passed | Outcome | Hits | Fixture citation issues | Generated citation check | Issues |",
        "|---|---:|---|---|---|---:|---|", *map(row, report["cases"]),
    ]
    return markdown(
        "Evaluation report",
        [
            ("Summary", [
                f"- Suite: `{report['suite_name']}`", f"- Trust layer status: {report['trust_layer_status']}",
                f"- Cases passed: {report['passed_case_count']}/{report['case_count']}",
                f"- Overall status: {'pass' if report['valid'] else 'fail'}",
            ]),
            ("Corpus/config", [
                f"- Corpus directory: `{summary['corpus_dir']}`", f"- Metadata files seen: {summary['metadata_files_seen']}",
                f"- Documents valid: {summary['documents_valid']}", f"- Documents retrievable: {summary['documents_retrievable']}",
                f"- Documents excluded by status: {summary['documents_excluded']}", f"- Retrieval method: `{config['method']}`",
                f"- Top k: {config['top_k']}", f"- Score floor: {config['score_floor']}",
            ]),
            ("Metrics", [f"- `{k}`: {v}" for k, v in report["metrics"].items()]),
            ("Case table", table),
            ("Limits", ["A citation that resolves names a chunk that was retrieved; whether the chunk supports the words is not measured."]),
        ],
    )


def comparison_markdown(report: dict) -> str:
    """Rankings compared. report: n_chunks, model, metrics {tier: {method: recall_at_1, recall_at_3,
    recall_at_5, mrr, n}}, separation {method: min_on_topic, max_off_topic, clean, midpoint}, gate
    (refused_off_topic, n_off_topic, refused_on_topic, n_on_topic), queries [{id, tier, ranks
    {method: rank or None}}]."""
    methods = list(report["separation"])
    sections: list[tuple[str, list[str]]] = [
        ("Corpus", [f"- Chunks: {report['n_chunks']}", f"- Vectors: `{report['model']}`", f"- Methods: {', '.join(methods)}"])
    ]
    for tier, own in report["metrics"].items():
        rows = [
            f"| {m} | " + " | ".join(f"{own[m][k]:.2f}" for k in ("recall_at_1", "recall_at_3", "recall_at_5", "mrr")) + " |"
            for m in methods
        ]
        head = ["| method | recall@1 | recall@3 | recall@5 | MRR |", "|---|---:|---:|---:|---:|"]
        sections.append((f"{tier.capitalize()} queries (n={own[methods[0]]['n']})", head + rows))
    rows = [
        f"| {m} | {s['min_on_topic']:.3f} | {s['max_off_topic']:.3f} | {'yes' if s['clean'] else 'no'} |"
        for m, s in report["separation"].items()
    ]
    gate = report["gate"]
    told = (
        f"The coverage gate refuses {gate['refused_off_topic']}/{gate['n_off_topic']} off-topic queries and, wrongly, "
        f"{gate['refused_on_topic']}/{gate['n_on_topic']} on-topic ones."
    )
    head = ["| method | least on-topic | most off-topic | apart? |", "|---|---:|---:|:--:|"]
    sections.append(("Separation", [*head, *rows, "", told]))
    hard = [q for q in report["queries"] if q["tier"] == "hard"]
    rows = [f"| {q['id']} | " + " | ".join(str(q["ranks"][m] or "-") for m in methods) + " |" for q in hard]
    sections.append(("First relevant rank, hard queries", [f"| query | {' | '.join(methods)} |", f"|---|{'---:|' * len(methods)}", *rows]))
    best = max(methods, key=lambda m: report["metrics"].get("hard", report["metrics"]["all"])[m]["mrr"])
    clean = [f"{m} (at {s['midpoint']:.2f})" for m, s in report["separation"].items() if s["clean"]]
    sections.append(("Verdict", [f"- Best on hard queries: {best}", f"- One threshold parts on-topic from off-topic for: {', '.join(clean) or 'none'}"]))
    return markdown("Retrieval methods compared", sections)


def write_report(spark: SparkSession, path: str, record: dict, ordered: bool = True) -> None:
    """A report as JSON, with sorted keys unless ordered=False."""
    write_text(spark, path, dump(record, ordered))


def append_audit(events: DataFrame, path: str) -> None:
    """Audit lines, one JSON object each with sorted keys. Appends; never rewrites."""
    events.select(*sorted(events.columns)).write.mode("append").json(path)


def demo_export(chunks: DataFrame, held: DataFrame, documents: DataFrame) -> str:
    """Chunks, held-out chunks, excluded documents and sources as one JSON text."""
    rows = lambda df: [r.asDict(True) for r in df.orderBy("doc_id", "chunk_index").toLocalIterator()]
    out = excluded_documents(documents).orderBy("doc_id")
    return json.dumps({
        "chunks": rows(chunks), "held_out_chunks": rows(held),
        "excluded_documents": [r.asDict(True) for r in out.toLocalIterator()],
        "sources": {r["source_file_path"]: r["raw_text"] for r in documents.toLocalIterator()},
    }, sort_keys=True)


def excluded_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(~F.col("status").isin(*RETRIEVABLE)).select(
        "doc_id", "doc_title", "doc_type", "version", "status", "department", "source_file_path"
    )


def yaml_sidecars(documents: DataFrame) -> DataFrame:
    """(source_file_path, sidecar): metadata as YAML text."""
    fields = ["doc_id", "doc_title", "doc_type", "version", "status", "department", "source_file_path", "source_hash"]

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for f in frames:
            texts = [yaml.safe_dump(r, sort_keys=False, allow_unicode=True) for r in f.to_dict("records")]
            yield pd.DataFrame({"source_file_path": f["source_file_path"], "sidecar": texts})

    return documents.select(*fields).mapInPandas(render, "source_file_path string, sidecar string")
