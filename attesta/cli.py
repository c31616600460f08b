"""The operations as commands: python -m attesta COMMAND. Results go to standard output, what is wrong
to standard error; the exit code is 1 if a check fails and 2 if the input can't be used."""

from __future__ import annotations

# The commands, their options and the labels of the lines that they print.

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.validation import CorpusInvalid
from .plans import service
from .sources import bundles, sinks


class Failed(Exception):
    """A check that the command makes has failed."""


def _count(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attesta", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=about)
        for p in positional:
            own.add_argument(p)
        return own

    command("validate-corpus", "check sidecars, hashes and versions of a corpus", "corpus_dir")
    own = command("onboard-corpus", "map a messy bundle into a clean corpus", "bundle_dir")
    own.add_argument("--mapping")
    own.add_argument("--register")
    own.add_argument("--output", required=True)
    own.add_argument("--report-out", required=True)
    own.add_argument("--markdown-out")
    for flag in ("--dry-run", "--force", "--require-no-review", "--json"):
        own.add_argument(flag, action="store_true")
    own = command("retrieve", "ranked chunks for a question", "corpus_dir")
    own.add_argument("--query", required=True)
    own.add_argument("--top-k", type=_count, default=5)
    own.add_argument("--json", action="store_true")
    own = command("answer", "an extractive answer with checked citations", "corpus_dir")
    own.add_argument("--query", required=True)
    own.add_argument("--top-k", type=_count, default=3)
    own = command("validate-citations", "check an answer's citations against retrieved chunks", "retrieved", "answer")
    own.add_argument("--json", action="store_true")
    own = command("evaluate", "run a suite of questions", "corpus_dir", "suite")
    own.add_argument("--json-out")
    own.add_argument("--markdown-out")
    own.add_argument("--json", action="store_true")
    return top


def _calls(spark: SparkSession, corpus_dir: str) -> service.Service:
    return service.Service(spark, {"corpus": corpus_dir})


def _validate_corpus(spark, a) -> None:
    report = _calls(spark, a.corpus_dir).validate_corpus()
    print(f"Metadata files seen: {report['metadata_files_seen']}")
    print(f"Documents valid: {report['documents_valid']}")
    print(f"Documents retrievable: {report['documents_retrievable']}")
    print(f"Documents excluded by status: {report['documents_excluded']}")
    if not report["valid"]:
        for issue in report["issues"]:
            print(f"- {issue['path']}: {issue['message']}", file=sys.stderr)
        raise Failed("corpus validation failed")
    print("Corpus validation passed")


def _onboard_corpus(spark, a) -> None:
    report = service.onboard(spark, a.bundle_dir, a.output, a.dry_run, a.force, a.mapping, a.register)
    sinks.write_report(spark, a.report_out, report)
    if a.markdown_out:
        sinks.write_text(spark, a.markdown_out, sinks.onboarding_markdown(report))
    states = report["state_counts"]
    if a.json:
        print(bundles.dump(report), end="")
    else:
        print(f"Input documents: {report['input_document_count']}")
        print(f"Emitted documents: {report['emitted_document_count']}")
        for state, n in states.items():
            print(f"{state}: {n}")
    if a.require_no_review and (states["needs_review"] or states["rejected"]):
        raise Failed("records need review or were rejected")


def _retrieve(spark, a) -> None:
    found = _calls(spark, a.corpus_dir).retrieve(a.query, top_k=a.top_k)
    if a.json:
        print(json.dumps({k: found[k] for k in ("query", "retrievable_documents", "hits")}, indent=2))
        return
    if not found["hits"]:
        print("No retrievable chunks matched the query.")
    for hit in found["hits"]:
        print(f"{hit['rank']}. {hit['doc_id']} {hit['chunk_id']} score={hit['score']:.4f}")
        print(f"   {hit['section_heading']} ({hit['line_or_page_span']})")
        print(f"   {hit['source_file_path']}")


def _answer(spark, a) -> None:
    print(json.dumps(_calls(spark, a.corpus_dir).answer(a.query, top_k=a.top_k), indent=2))


def _validate_citations(spark, a) -> None:
    result = service.check_citations(spark, a.retrieved, a.answer)
    if a.json:
        print(json.dumps(result, indent=2))
    else:
        print("Metric: citation_resolves_to_retrieved_chunk")
        print(f"citation_resolves_to_retrieved_chunk: {result['citation_resolves']}")
        print(f"Resolved citations: {result['resolved_citation_count']}")
        for code in result["issue_codes"]:
            print(f"- {code}")
    if not result["valid"]:
        raise Failed("citation validation failed")


def _evaluate(spark, a) -> None:
    report = _calls(spark, a.corpus_dir).evaluate(a.suite)
    if a.json_out:
        sinks.write_report(spark, a.json_out, report, ordered=False)
    if a.markdown_out:
        sinks.write_text(spark, a.markdown_out, sinks.evaluation_markdown(report))
    if a.json:
        print(json.dumps(report, indent=2))
    else:
        print(f"Suite: {report['suite_name']}")
        print(f"Trust layer status: {report['trust_layer_status']}")
        print(f"Cases passed: {report['passed_case_count']}/{report['case_count']}")
        for name, value in report["metrics"].items():
            print(f"{name}: {value}")
    if not report["valid"]:
        raise Failed("evaluation failed")


_RUN = {
    "validate-corpus": _validate_corpus, "onboard-corpus": _onboard_corpus, "retrieve": _retrieve, "answer": _answer,
    "validate-citations": _validate_citations, "evaluate": _evaluate,
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("attesta").getOrCreate()
    try:
        _RUN[a.command](spark, a)
    except Failed as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except CorpusInvalid as e:
        for issue in e.issues:
            print(f"- {issue['path']}: {issue['message']}", file=sys.stderr)
        print("Error: corpus validation failed", file=sys.stderr)
        return 1
    except bundles.BundleError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2
    return 0
