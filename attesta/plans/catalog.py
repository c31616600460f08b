"""Queries over the driver's tables, one per operator, and the SQL that must agree with them.

Every query runs over whole tables. Doubles are rounded on both sides after ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, bm25, chunking, evaluation, libraries, onboarding, postings, products, ranking, segments, snapshots, validation
from ..sources import bundles, sinks, store, tables
from ..vocabulary import RetrievalConfig
from ..streaming import audit
from . import oracles

QUERIES: dict = {}
ORACLES: dict[str, str] = oracles.SQL

CONFIG = RetrievalConfig(top_k=5)
#: The coverage that benchmark passages reach is low; this gate lets some pass and refuses others.
GATED = RetrievalConfig(top_k=5, min_top_coverage=0.4)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.controlled_documents(tables.table(spark, sf, "documents"))


_held: dict[bool, bm25.Index] = {}


def _index(spark: SparkSession, sf: str, gate: bool = True) -> bm25.Index:
    """An index of the query's own. The one that an earlier query kept is released, so that no query
    reads another's, and a session holds two at most."""
    if gate in _held:
        _held.pop(gate).release()
    _held[gate] = bm25.build_retriever(_docs(spark, sf), CONFIG, gate)
    return _held[gate]


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return tables.questions(tables.table(spark, sf, "benchmark")).select("query_id", "question")


def _hits(spark: SparkSession, sf: str, config: RetrievalConfig = GATED) -> DataFrame:
    return bm25.hits(_index(spark, sf), _asked(spark, sf), config)


# filters and validation


@query
def status_gate(spark, sf):
    return chunking.status_gate(_docs(spark, sf)).select("doc_id", "status", "version")


@query
def ingest_report(spark, sf):
    docs = _docs(spark, sf)
    return validation.ingest_report(F.count("*"), docs)


@query
def duplicate_current_version(spark, sf):
    docs = _docs(spark, sf).withColumn("doc_id", F.col("family"))
    return validation.duplicate_current(docs)


@query
def metadata_checks(spark, sf):
    return _docs(spark, sf).select("doc_id", validation.metadata_problem().alias("problem"))


@query
def source_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", T.source_hash(F.col("raw_text").cast("binary")).alias("source_hash"))


@query
def corpus_check(spark, sf):
    """Validation end to end over sidecars and files made from documents, some of them broken."""
    docs = _docs(spark, sf)
    n = F.col("doc_number")
    sidecars = docs.select(
        F.concat(F.lit("metadata/"), n.cast("string"), F.lit(".yaml")).alias("sidecar_path"),
        F.lit(None).cast("string").alias("parse_problem"),
        (n % 13 != 0).alias("inside"),
        F.col("family").alias("doc_id"), "doc_title", "doc_type", "version", "status", "department",
        "effective_date", "review_due_date",
        F.when(n % 17 == 0, F.concat("source_file_path", F.lit(".gone"))).otherwise(F.col("source_file_path")).alias("source_file_path"),
        F.when(n % 19 == 0, F.concat(F.lit("sha256:"), F.repeat(F.lit("0"), 64))).otherwise(F.col("source_hash")).alias("source_hash"),
    )
    files = docs.select(F.col("source_file_path").alias("path"), F.col("raw_text").cast("binary").alias("content"))
    _, issues = validation.check(sidecars, files)
    return issues


@query
def resolved_sources(spark, sf):
    """Validation of sidecars that name their sources by paths with dots, in folders of any depth."""
    docs = _docs(spark, sf)
    n = F.col("doc_number")
    number = n.cast("string")
    named = (
        F.when(n % 6 == 0, F.concat(F.lit("./documents/"), number, F.lit(".md")))
        .when(n % 6 == 1, F.concat(F.lit("documents/gone/../sub//"), number, F.lit(".md")))
        .when(n % 6 == 2, F.concat(F.lit("annex/a/b/./../"), number, F.lit(".md")))
        .when(n % 6 == 3, F.concat(F.lit("documents/../../other/"), number, F.lit(".md")))
        .when(n % 6 == 4, F.concat(F.lit("/documents/"), number, F.lit(".md")))
        .otherwise(F.concat(F.lit("x/y/../../documents/sub/./"), number, F.lit(".md")))
    )
    folder = F.when(n % 6 == 0, "documents").when(n % 6 == 2, "annex/a").otherwise("documents/sub")
    sidecars = docs.select(
        F.concat(F.lit("metadata/"), number, F.lit(".yaml")).alias("sidecar_path"), F.lit(None).cast("string").alias("parse_problem"),
        F.lit(True).alias("inside"), "doc_id", "doc_title", "doc_type", "version", "status", "department", "effective_date",
        F.lit(None).cast("string").alias("review_due_date"), named.alias("source_file_path"), "source_hash",
    )
    files = docs.filter(n % 17 != 0).select(
        F.concat(folder, F.lit("/"), number, F.lit(".md")).alias("path"), F.col("raw_text").cast("binary").alias("content")
    )
    documents, issues = validation.check(sidecars, files)
    valid = documents.select(F.col("source_file_path").alias("path"), F.lit("valid").alias("message"))
    return valid.unionByName(issues)


# chunks


@query
def line_offsets(spark, sf):
    return chunking.line_table(_docs(spark, sf))


@query
def chunk_documents(spark, sf):
    return chunking.chunk_documents(_docs(spark, sf))


@query
def segment_chunks(spark, sf):
    """The same chunks, with all documents beyond 300 characters chunked by segments."""
    return segments.chunk_any(_docs(spark, sf), size=300)


@query
def chunk_spans(spark, sf):
    """Every chunk's text against the span that it names, all statuses."""
    docs = _docs(spark, sf)
    chunks = chunking.chunk_documents(docs, gate=False)
    same = F.col("text") == F.substring(F.col("raw_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return (
        chunks.join(docs.select("doc_id", "raw_text"), "doc_id").groupBy("status")
        .agg(F.count("*").alias("n_chunks"), F.count_if(same).alias("n_exact"))
    )


@query
def tokenize(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


@query
def content_terms(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(F.sort_array(T.content_terms(F.col("text"))), " ").alias("terms"))


# index and retrieval


@query
def term_freq(spark, sf):
    return bm25.term_frequency(bm25.tokenized(chunking.chunk_documents(_docs(spark, sf))))


@query
def doc_freq(spark, sf):
    return bm25.document_frequency(bm25.tokenized(chunking.chunk_documents(_docs(spark, sf))))


@query
def corpus_stats(spark, sf):
    stats = bm25.corpus_stats(bm25.tokenized(chunking.chunk_documents(_docs(spark, sf))))
    return stats.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query
def idf(spark, sf):
    at = _index(spark, sf).idf
    return at.withColumns({c: F.round(c, 6) for c in ("raw_idf", "idf")})


@query
def bm25_scores(spark, sf):
    return bm25.score(_index(spark, sf), _asked(spark, sf)).withColumn("score", F.round("score", 6))


@query
def bm25_topk(spark, sf):
    found = bm25.top(_index(spark, sf), _asked(spark, sf), CONFIG.top_k)
    return found.withColumn("score", F.round("score", 6))


@query
def stored_topk(spark, sf):
    """The same hits, from postings that have been written in buckets and loaded again."""
    at = store.shared_folder(spark)
    postings.build(_docs(spark, sf), at, buckets=32)
    found = bm25.top(postings.load(spark, at), _asked(spark, sf), CONFIG.top_k)
    return found.withColumn("score", F.round("score", 6))


@query
def library_hits(spark, sf):
    """Questions over eight corpora in one index, one of them with a third of all documents; each question
    asks two of them."""
    n = F.col("doc_number")
    corpus = F.when(n % 3 == 0, "main").otherwise(F.concat(F.lit("c"), (n % 7).cast("string")))
    of = F.array(F.lit("main"), F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string")))
    asked = tables.questions(tables.table(spark, sf, "benchmark")).select(F.explode(of).alias("corpus"), "query_id", "question")
    library = libraries.build(_docs(spark, sf).withColumn("corpus", corpus))
    at = store.shared_folder(spark)
    libraries.save(library, at)
    library.release()
    found = libraries.hits(libraries.load(spark, at), asked, GATED)
    return found.select("corpus", "query_id", "rank", "chunk_id", *(F.round(c, 6).alias(c) for c in ("score", "coverage")))


@query
def incremental_idf(spark, sf):
    """The index of the corpus, by difference from an earlier one: some documents are new, some had
    another text or status, some are gone."""
    now = _docs(spark, sf)
    n = F.col("doc_number")
    text = F.when(n % 7 == 0, F.concat(F.col("raw_text"), F.lit("\n\nAn earlier end."))).otherwise(F.col("raw_text"))
    before = now.filter(n % 5 != 0).withColumns({
        "raw_text": text, "source_hash": F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256)),
        "status": F.when(n % 11 == 0, "Approved").otherwise(F.col("status")),
    })
    gone = now.filter(n % 13 == 0).withColumns({"doc_id": F.concat("doc_id", F.lit("-X")), "status": F.lit("Effective")})
    old = snapshots.take(before.unionByName(gone)).save(store.shared_folder(spark))
    at = snapshots.update(old, now).index().idf
    return at.withColumns({c: F.round(c, 6) for c in ("raw_idf", "idf")})


@query
def coverage_rank1(spark, sf):
    found = bm25.covered(_index(spark, sf), _asked(spark, sf), CONFIG, last=1)
    return found.select("query_id", "chunk_id", F.round("coverage", 6).alias("coverage"))


@query
def gated_hits(spark, sf):
    found = _hits(spark, sf)
    return found.select("query_id", "rank", "doc_id", "chunk_id", "status", "line_or_page_span", F.round("score", 6).alias("score"))


@query
def status_blind_topk(spark, sf):
    found = bm25.hits(_index(spark, sf, gate=False), _asked(spark, sf), CONFIG, gate=False)
    return found.select("query_id", "rank", "chunk_id", "status", F.round("score", 6).alias("score"))


@query
def held_out_hits(spark, sf):
    found = bm25.held_out(_index(spark, sf, gate=False), _asked(spark, sf), CONFIG)
    return found.select("query_id", "rank", "chunk_id", "status", F.round("score", 6).alias("score"))


@query
def held_out_best_per_doc(spark, sf):
    found = bm25.held_out(_index(spark, sf, gate=False), _asked(spark, sf), RetrievalConfig(top_k=20))
    return bm25.best_per_document(found).select("query_id", "doc_id", "rank", "chunk_id")


@query
def conversation_retrieval(spark, sf):
    """User turns as queries."""
    asked = tables.conversation_questions(tables.table(spark, sf, "conversations"))
    found = bm25.top(_index(spark, sf), asked, 3)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


# answers


@query
def extractive_answer(spark, sf):
    asked = _asked(spark, sf)
    at = answers.extractive_answers(asked, _hits(spark, sf))
    return at.select(
        "query_id", "outcome", "answer_text",
        F.array_join(F.transform("citations", lambda c: F.concat(c["label"], F.lit("="), c["chunk_id"])), ";").alias("citations"),
    )


def fixtures(spark, sf) -> DataFrame:
    """One answer fixture per question, some sound and some traps, against status-blind hits."""
    asked = tables.questions(tables.table(spark, sf, "benchmark"))
    found = bm25.hits(_index(spark, sf, gate=False), asked, RetrievalConfig(top_k=3), gate=False)
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "status")))
    at = asked.join(found.groupBy("query_id").agg(listed.alias("h")), "query_id", "left")
    got = F.transform(F.coalesce("h", F.array()), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["status"].alias("status")))
    cite = lambda x, i: F.struct(x["chunk_id"].alias("chunk_id"), (i + 1).cast("string").alias("label"))
    odd = F.array(F.struct(F.lit("NO-SUCH_chunk_001").alias("chunk_id"), F.lit("9").alias("label")))
    kind = F.col("item_id") % 4
    return at.select(
        "query_id", "question", "item_id",
        F.when(kind == 3, "refusal").otherwise("answer").alias("outcome"),
        F.when(kind == 1, F.array()).when(kind == 2, F.concat(F.transform(got, cite), odd)).otherwise(F.transform(got, cite))
        .cast(answers.CITATIONS).alias("citations"),
        got.cast(answers.RETRIEVED).alias("retrieved"),
    )


@query
def citation_validation(spark, sf):
    at = answers.validate_citations(fixtures(spark, sf))
    return at.select(
        "query_id", "outcome", "answer_citation_count", "retrieved_chunk_count", "resolved_citation_count",
        "citation_resolves", F.array_join("issue_codes", ",").alias("issue_codes"), "valid",
    )


@query
def review_routing(spark, sf):
    at = answers.route_review(answers.extractive_answers(_asked(spark, sf), _hits(spark, sf)), 0.0, 20.0)
    return at.select("query_id", "outcome", "review_recommended", F.array_join("review_reasons", ",").alias("review_reasons"))


# evaluation


def cases(spark, sf) -> DataFrame:
    """A suite made from benchmark: every passage is a case."""
    asked = tables.questions(tables.table(spark, sf, "benchmark"))
    n = F.col("item_id")
    none = F.array().cast("array<string>")
    doc = F.format_string("DOC-%06d", n)
    answer = n % 3 != 2
    fixture = n % 4 == 0
    outcome = F.when(answer, "answer").otherwise("refusal")
    return asked.select(
        F.col("query_id").alias("case_id"), "question", outcome.alias("expected_outcome"),
        (n % 3 + 1).cast("int").alias("top_k"),
        F.when(n % 5 == 0, F.array(doc)).otherwise(none).alias("expected_source_doc_ids"),
        none.alias("expected_chunk_ids"),
        F.when(n % 6 == 1, F.array(doc)).otherwise(none).alias("forbidden_doc_ids"),
        (~answer).alias("expect_no_hits"),
        F.when(fixture, outcome).alias("fixture_outcome"),
        F.array().cast(answers.CITATIONS).alias("fixture_citations"),
        F.when(fixture, ~answer).alias("expected_resolves"),
        F.when(fixture & answer, F.array(F.lit("missing_answer_citation"))).otherwise(none).alias("expected_issue_codes"),
    )


@query
def eval_cases(spark, sf):
    at = evaluation.run_cases(_index(spark, sf), cases(spark, sf), GATED)
    return at.withColumns(
        {c: F.array_join(c, ",") for c in ("hit_chunk_ids", "hit_doc_ids", "citation_issue_codes", "issues")}
    )


@query
def eval_metrics(spark, sf):
    _, metrics = evaluation.evaluate(_index(spark, sf), cases(spark, sf), GATED)
    return metrics


# onboarding


MAPPING = {
    "status_map": {"approved": "Approved", "in force": "Effective", "draft": "Draft", "old": "Obsolete", "replaced": "Superseded"},
    "doc_type_map": {"procedure": "SOP", "policy": "Policy"},
    "filename_patterns": [(r"^(M-\d+)_v([\d.]+)\.md$", ["doc_id", "version"])],
    "header_fields": {"status": "Status", "department": "Department"},
    "required_fields": ["doc_id", "doc_title", "doc_type", "version", "status", "effective_date", "department"],
}


def messy(spark, sf) -> DataFrame:
    """A messy bundle made from documents: registers with gaps, odd statuses, clashing versions."""
    n = F.col("doc_id")
    status = (
        F.when(n % 9 == 0, "approved").when(n % 9 == 1, "draft").when(n % 9 == 2, "wip").when(n % 9 == 3, "old")
        .when(n % 9 == 4, "replaced").otherwise("in force")
    )
    version = F.concat(F.when(n % 2 == 0, "v").otherwise("rev-"), F.lit("1."), (n % 4).cast("string"))
    register = F.struct(
        F.when(n % 3 == 0, F.format_string("M-%d", n % 300)).alias("doc_id"),
        F.when(n % 29 != 0, F.concat(F.lit("Title "), n.cast("string"))).alias("doc_title"),
        F.when(n % 31 == 0, "memo").when(n % 2 == 0, "procedure").otherwise("policy").alias("doc_type"),
        version.alias("version"),
        F.when(n % 8 != 0, status).alias("status"),
        F.when(n % 23 != 0, F.format_string("2024-01-%02d", n % 28 + 1)).alias("effective_date"),
        F.lit(None).cast("string").alias("department"),
        (n % 6 == 0).alias("current_version"),
    )
    head = F.concat(
        F.when(n % 8 == 0, F.concat(F.lit("Status: "), status, F.lit("\n"))).otherwise(""),
        F.lit("DEPARTMENT: "), "source", F.lit("\n\n"),
    )
    docs = tables.table(spark, sf, "documents")
    return docs.select(
        F.format_string("incoming/documents/M-%d_v1.%d.md", n % 300, F.when(n % 11 == 0, 7).otherwise(n % 4)).alias("_path"),
        n.alias("doc_number"),
        (n % 41 != 0).alias("safe"),
        F.when(n % 37 == 0, F.lit(None)).when(n % 43 == 0, F.lit(" \n")).otherwise(F.concat(head, F.coalesce("text", F.lit("")))).alias("raw_text"),
        register.alias("register"),
    ).withColumn("source_path", F.col("_path")).drop("_path")


def records(spark, sf) -> DataFrame:
    """Records with a key, as the invented paths repeat."""
    sources = messy(spark, sf).withColumn("source_path", F.concat(F.lit("incoming/documents/"), F.col("doc_number").cast("string"), F.lit("/"), F.substring_index("source_path", "/", -1)))
    return onboarding.review_duplicates(onboarding.evaluate_sources(sources, MAPPING))


@query
def onboard_version_norm(spark, sf):
    return messy(spark, sf).select("doc_number", T.normalize_version(F.col("register.version")).alias("version"))


@query
def onboard_records(spark, sf):
    at = records(spark, sf)
    return at.select(
        "source_path", "state", "retrievable", F.array_join("reasons", ",").alias("reasons"),
        "doc_id", "doc_title", "doc_type", "version", "canonical_status", "effective_date", "department",
    )


@query
def onboard_conflicts(spark, sf):
    hit = F.explode(F.filter("reasons", lambda r: r.startswith("conflicting_field_sources:")))
    return records(spark, sf).select(hit.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query
def onboard_states(spark, sf):
    return onboarding.state_counts(records(spark, sf))


@query
def field_coverage(spark, sf):
    return onboarding.field_coverage(records(spark, sf))


@query
def status_counts(spark, sf):
    return onboarding.status_counts(records(spark, sf))


@query
def unknown_statuses(spark, sf):
    return onboarding.unknown_statuses(records(spark, sf))


@query
def duplicate_review(spark, sf):
    twice = F.array_contains("reasons", "duplicate_current_version")
    return records(spark, sf).filter(twice).select("source_path", "doc_id", "state")


@query
def source_paths(spark, sf):
    """Files found and files registered, each once; of a path's registrations the last."""
    docs = tables.table(spark, sf, "documents")
    found = docs.select(F.concat(F.lit("d/"), (F.col("doc_id") % 500).cast("string")).alias("source_path"))
    listed = docs.select(
        F.concat(F.lit("d/"), (F.col("doc_id") % 700).cast("string")).alias("source_path"),
        F.col("doc_id").alias("position"), F.col("lang").alias("language"),
    )
    last = onboarding.last_of_path(listed)
    return onboarding.source_paths(found, listed).join(last, "source_path", "left")


@query
def normalized_corpus(spark, sf):
    """The clean corpus that onboarding emits."""
    sources = messy(spark, sf).withColumn("source_path", F.concat(F.lit("incoming/documents/"), F.col("doc_number").cast("string"), F.lit("/"), F.substring_index("source_path", "/", -1)))
    return sinks.normalized_corpus(records(spark, sf), sources).drop("raw_text")


# rankings


def _vectors(spark, sf):
    e = tables.table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    return rows


def _asked_vectors(spark, sf) -> DataFrame:
    """Each label's first vector asks."""
    first = _vectors(spark, sf).groupBy("label").agg(F.min_by("vector", "item_id").alias("vector"))
    return first.select(F.col("label").cast("long").alias("query_id"), "vector")


@query
def cosine_topk(spark, sf):
    at = products.cosine_topk(_asked_vectors(spark, sf), _vectors(spark, sf), 10)
    return at.withColumn("score", F.round("score", 6))


def _rankings(spark, sf) -> dict[str, DataFrame]:
    """By cosine, by the first component alone, and both fused."""
    asked, rows = _asked_vectors(spark, sf), _vectors(spark, sf)
    most = rows.count()  # from the files' footers; no query has more
    cosines = ranking.ranked(products.scores(asked, rows), most)
    other = ranking.ranked(products.scores(asked, rows, first=1), most)
    return {"cosine": cosines, "first": other, "fused": ranking.fuse(cosines, other, most=most)}


def _fused(spark, sf):
    return _rankings(spark, sf)["fused"]


def _last_of_label(spark, sf) -> DataFrame:
    """relevant(query_id, tier, item_id): a label's last vector."""
    own = _vectors(spark, sf).groupBy("label").agg(F.max("item_id").alias("item_id"))
    tier = F.when(F.col("label") % 2 == 0, "easy").otherwise("hard")
    return own.select(F.col("label").cast("long").alias("query_id"), tier.alias("tier"), "item_id")


@query
def rrf_fusion(spark, sf):
    return _fused(spark, sf).withColumn("score", F.round("score", 9))


@query
def recall_mrr(spark, sf):
    """How early a label's ranking shows another of its own vectors."""
    at = ranking.recall_mrr(ranking.first_relevant(_fused(spark, sf), _last_of_label(spark, sf)), (1, 100, 500))
    return at.withColumns({c: F.round(c, 6) for c in ("recall_at_1", "recall_at_100", "recall_at_500", "mrr")})


@query
def best_method(spark, sf):
    """Which of three rankings shows a label's last vector earliest, by tier."""
    relevant = _last_of_label(spark, sf)
    each = [
        ranking.recall_mrr(ranking.first_relevant(found, relevant)).select("tier", F.lit(name).alias("method"), F.round("mrr", 9).alias("mrr"))
        for name, found in _rankings(spark, sf).items()
    ]
    return ranking.best_method(each[0].unionByName(each[1]).unionByName(each[2]))


@query
def separation(spark, sf):
    """Questions from the benchmark against turns of users, which the corpus doesn't hold."""
    index = _index(spark, sf)
    on = _asked(spark, sf).withColumn("on_topic", F.lit(True))
    off = tables.conversation_questions(tables.table(spark, sf, "conversations")).withColumn("on_topic", F.lit(False))
    asked = on.unionByName(off)
    best = bm25.covered(index, asked, RetrievalConfig(top_k=1)).select("query_id", "score", "coverage")
    top = asked.join(best, "query_id", "left").select(
        "query_id", "on_topic", F.coalesce("score", F.lit(0.0)).alias("top_score"), F.coalesce("coverage", F.lit(0.0)).alias("top_coverage")
    )
    at = ranking.separation(top)
    return at.withColumns({c: F.round(c, 6) for c in ("min_on_topic", "max_off_topic", "midpoint")})


# sinks


@query
def excluded_documents(spark, sf):
    return sinks.excluded_documents(_docs(spark, sf))


@query
def yaml_sidecars(spark, sf):
    return sinks.yaml_sidecars(_docs(spark, sf))


@query
def page_questions(spark, sf):
    """Questions that pages offer: each page's links as data-q attributes, scraped and decoded."""
    pages = tables.table(spark, sf, "pages")
    page = pages.select(F.regexp_replace("html", r'href="/([^"]*)"', r'data-q="$1"').alias("html"))
    asked = bundles.scrape_questions(page)
    return asked.groupBy("question").agg(F.count("*").alias("n"))


@query
def audit_counts(spark, sf):
    """Events by hour and type: what the audit stream gives when all has come."""
    e = tables.table(spark, sf, "events")
    return (
        e.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .withColumns({"window_start": F.unix_timestamp("window_start"), "total": F.round("total", 4)})
    )


@query
def audit_log(spark, sf):
    """Events as audit lines that a stream has moved from a spool of files into a log, by batches."""
    spool, log = store.shared_folder(spark), store.shared_folder(spark)
    line = F.to_json(F.struct("event_id", "event_type", "user_id"))
    tables.table(spark, sf, "events").select(line.alias("value")).repartition(8, "value").write.text(spool)
    audit.record(spark, spool, log, files=3).awaitTermination()
    kept = F.from_json("value", "event_id long, event_type string, user_id long")
    return audit.recorded(spark, log).select(kept.alias("e")).select("e.*")
