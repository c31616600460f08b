"""The operations of the system as calls, over an allowlist of corpora, with one audit line each.

A transport is a thin layer above; attesta.cli is the one for a command line."""

from __future__ import annotations

import hmac
import time
import uuid
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, bm25, evaluation, onboarding, postings, validation
from ..operators.segments import DOCUMENT
from ..sources import bundles, corpora, sinks
from ..sources.store import Store
from ..streaming import audit
from ..vocabulary import RetrievalConfig

#: Issues of a corpus that a call returns at most.
ISSUES = 10_000
#: Fields of a hit's record.
HIT = (
    "rank", "score", "chunk_id", "doc_id", "doc_title", "version", "status", "section_heading",
    "source_file_path", "source_hash", "line_or_page_span", "text",
)


class Unauthorized(Exception):
    """A call without the key that the service asks for."""


class UnknownCorpus(Exception):
    """A corpus that the registry doesn't list."""


class Service:
    """corpora: name to folder, the first one is the default. Indexes are built once per corpus from
    a snapshot; validation and evaluation read the folder anew.

    spool: a folder for audit lines that audit.record() moves into a log; a call puts a file there and
    runs no job. audit_path: lines are appended there by a job per call. indexes: a folder for stored
    indexes, named by what the corpus holds, so that a session takes the one of an earlier session as
    long as the corpus is the same, and stores one otherwise."""

    def __init__(
        self, spark: SparkSession, corpora: str | dict[str, str], api_key: str | None = None,
        audit_path: str | None = None, review_margin: float = 1.0, spool: str | None = None, indexes: str | None = None,
    ):
        self.spool, self.indexes = spool, indexes
        self.spark, self.key, self.audit_path, self.margin = spark, api_key, audit_path, review_margin
        self.corpora = bundles.corpus_registry(spark, corpora) if isinstance(corpora, str) else dict(corpora)
        self._indexes: dict[tuple[str, bool], bm25.Index] = {}

    def health(self) -> dict:
        """No key, no audit line."""
        return {"status": "ok", "corpora": sorted(self.corpora)}

    def _call(self, name: str, corpus: str | None, key: str | None, run) -> dict:
        began, outcome = time.time(), "error"
        try:
            if self.key is not None and not hmac.compare_digest(self.key, key or ""):
                outcome = "unauthorized"
                raise Unauthorized(name)
            corpus = corpus or next(iter(self.corpora))
            if corpus not in self.corpora:
                outcome = "unknown_corpus"
                raise UnknownCorpus(corpus)
            out = run(corpus)
            outcome = out.get("outcome", "ok")
            return out
        finally:
            self._audit(name, corpus, outcome, time.time() - began)

    def _audit(self, name: str, corpus: str | None, outcome: str, seconds: float) -> None:
        row = (str(uuid.uuid4()), datetime.now(UTC).isoformat(), name, corpus, outcome, round(seconds, 3))
        if self.spool:
            audit.note(self.spool, dict(zip(("request_id", "timestamp", "endpoint", "corpus", "outcome", "seconds"), row)))
        if self.audit_path:
            schema = "request_id string, timestamp string, endpoint string, corpus string, outcome string, seconds double"
            sinks.append_audit(self.spark.createDataFrame([row], schema).coalesce(1), self.audit_path)

    def _index(self, corpus: str, gate: bool = True) -> bm25.Index:
        if (corpus, gate) not in self._indexes:
            docs = bundles.load_corpus(self.spark, self.corpora[corpus])
            build = self._stored if self.indexes else lambda d, _, g: bm25.build_retriever(d, gate=g)
            self._indexes[corpus, gate] = build(docs, corpus, gate)
        return self._indexes[corpus, gate]

    def _stored(self, docs: DataFrame, corpus: str, gate: bool) -> bm25.Index:
        """The stored index of these documents; written first if there is none. A file that is put there
        last names the folder, so one that a failure left half is never read."""
        place = f"{quote(corpus, safe='')}/{'gated' if gate else 'blind'}-{fingerprint(docs)}"
        store = Store(self.indexes)
        if store.read(f"{place}/ready") is None:
            folder = uuid.uuid4().hex
            index = bm25.build_retriever(docs, gate=gate)
            try:
                postings.save(index, f"{self.indexes}/{place}/{folder}")
            finally:
                index.release()
            store.write(f"{place}/ready", folder.encode())
        return postings.load(self.spark, f"{self.indexes}/{place}/{store.read(f'{place}/ready').decode()}")

    def _asked(self, question: str):
        return self.spark.createDataFrame([("q", question)], "query_id string, question string")

    def _summary(self, name: str, docs) -> dict:
        seen = bundles.read_sidecars(self.spark, self.corpora[name]).count()
        return validation.ingest_report(seen, docs).first().asDict()

    def validate_corpus(self, corpus: str | None = None, key: str | None = None) -> dict:
        """Counts and issues; an invalid corpus is a result, not an error."""

        def run(name: str) -> dict:
            docs, issues = bundles.read_corpus(self.spark, self.corpora[name])
            found = [r.asDict() for r in issues.orderBy("path", "message").limit(ISSUES).collect()]
            return {**self._summary(name, docs), "issues": found, "valid": not found}

        return self._call("validate_corpus", corpus, key, run)

    def retrieve(self, question: str, corpus: str | None = None, top_k: int = 5, key: str | None = None) -> dict:
        """Hits, and what the status gate held out if there are none."""

        def run(name: str) -> dict:
            config = RetrievalConfig(top_k=top_k)
            hits = self._hits(name, question, config)
            gated = self._summary(name, bundles.load_corpus(self.spark, self.corpora[name]))["documents_retrievable"]
            out = {"query": question, "config": config.record(), "retrievable_documents": gated, "hits": hits, "held_out": []}
            if not hits:
                held = bm25.held_out(self._index(name, gate=False), self._asked(question), config)
                best = bm25.best_per_document(held).orderBy("rank").select(*HIT)
                out["held_out"] = [r.asDict() for r in best.collect()]
            return out

        return self._call("retrieve", corpus, key, run)

    def _hits(self, corpus: str, question: str, config: RetrievalConfig) -> list[dict]:
        found = bm25.hits(self._index(corpus), self._asked(question), config)
        return [r.asDict() for r in found.orderBy("rank").select(*HIT).collect()]  # top_k rows

    def answer(self, question: str, corpus: str | None = None, top_k: int = 3, key: str | None = None) -> dict:
        """An extractive answer or a refusal, its citations checked, with a review recommendation."""

        def run(name: str) -> dict:
            config = RetrievalConfig(top_k=top_k)
            asked = self._asked(question)
            found = bm25.hits(self._index(name), asked, config)
            at = answers.route_review(answers.checked_answers(asked, found), config.score_floor, self.margin)
            return at.first().asDict(True)

        return self._call("answer", corpus, key, run)

    def validate_citations(self, retrieval: str, fixture: str, corpus: str | None = None, key: str | None = None) -> dict:
        """Citations of an answer file against a retrieval file."""

        def run(_: str) -> dict:
            return check_citations(self.spark, retrieval, fixture)

        return self._call("validate_citations", corpus, key, run)

    def evaluate(self, suite: str, corpus: str | None = None, key: str | None = None) -> dict:
        """The report of a suite over a corpus that is read anew, cases in the order of the suite."""

        def run(name: str) -> dict:
            label, cases = bundles.load_suite(self.spark, suite)
            order = [r["case_id"] for r in cases.select("case_id").collect()]  # a row per case
            docs = bundles.load_corpus(self.spark, self.corpora[name])
            summary = {"corpus_dir": self.corpora[name], **self._summary(name, docs)}
            config = RetrievalConfig(top_k=3)
            index = bm25.build_retriever(docs)
            try:
                results, metrics = evaluation.evaluate(index, cases, config)
                rows = sorted((r.asDict(True) for r in results.collect()), key=lambda r: order.index(r["case_id"]))
                return sinks.evaluation_report(label, summary, config.record(), metrics.first().asDict(), rows)
            finally:
                index.release()

        return self._call("evaluate", corpus, key, run)


def fingerprint(docs: DataFrame) -> str:
    """A name for what a corpus holds: its documents' metadata and source hashes, in any order."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in DOCUMENT]
    sums = [F.sum(F.xxhash64(F.lit(k), *fields).cast("decimal(38,0)")) for k in range(2)]
    return "-".join(f"{int(x or 0) % 2**64:x}" for x in docs.agg(F.count("*"), *sums).first())


def check_citations(spark: SparkSession, retrieval: str, fixture: str) -> dict:
    """Citations of an answer file against a retrieval file. One row meets one row."""
    both = bundles.read_retrieval(spark, retrieval).crossJoin(bundles.read_answer(spark, fixture))
    return answers.validate_citations(both).first().asDict(True)


def onboard(
    spark: SparkSession, bundle_dir: str, output_dir: str | None = None, dry_run: bool = False, force: bool = False,
    mapping_path: str | None = None, register_path: str | None = None,
) -> dict:
    """Maps a messy bundle; writes the clean corpus unless dry_run, and returns the report, in which
    records that were written name their metadata. Paths default to the bundle's own files."""
    mapping_path = mapping_path or f"{bundle_dir}/{bundles.MAPPING}"
    register_path = register_path or f"{bundle_dir}/{bundles.REGISTER}"
    sources, mapping = bundles.read_bundle(spark, bundle_dir, mapping_path, register_path)
    hashes = {
        "mapping_config_hash": bundles.file_hash(spark, mapping_path),
        "source_register_hash": bundles.file_hash(spark, register_path),
    }
    records = onboarding.review_duplicates(onboarding.evaluate_sources(sources, mapping)).persist()
    try:
        written = None
        if output_dir and not dry_run:
            clean = sinks.normalized_corpus(records, sources)
            corpora.write(clean, output_dir, force)
            written = sinks.metadata_paths(clean)
        report = sinks.onboarding_report(records, bundle_dir.rstrip("/").rsplit("/", 1)[-1], hashes, written)
        report["normalized_corpus_dir"] = output_dir
        return report
    finally:
        records.unpersist()
