import hashlib
import json

import pytest
import yaml
from pyspark.sql import functions as F

from attesta.operators import bm25, evaluation, onboarding
from attesta.operators.validation import CorpusInvalid
from attesta.sources import bundles, sinks
from attesta.streaming import audit


def corpus(tmp_path, change=None):
    for d in ("metadata", "documents"):
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
    # the others keep words from standing in most chunks
    topics = {"A": "calibration", "B": "calibration", "X": "cleaning rooms", "Y": "training staff", "Z": "storing samples"}
    for k, topic in topics.items():
        status = "Draft" if k == "B" else "Approved"
        text = f"# Head\n\nDocument {k} covers {topic}.\n".encode()
        (tmp_path / f"documents/{k}.md").write_bytes(text)
        side = {
            "doc_id": f"DOC-{k}", "doc_title": k, "doc_type": "SOP", "version": "1.0", "status": status,
            "effective_date": "2024-01-01", "department": "QA", "source_file_path": f"documents/{k}.md",
            "source_hash": "sha256:" + hashlib.sha256(text).hexdigest(),
        }
        if change and k == "A":
            change(side, tmp_path)
        (tmp_path / f"metadata/{k}.yaml").write_text(yaml.safe_dump(side))
    return str(tmp_path)


def test_a_valid_corpus_loads(spark, tmp_path):
    docs = bundles.load_corpus(spark, corpus(tmp_path))
    assert docs.count() == 5 and {r["status"] for r in docs.collect()} == {"Approved", "Draft"}
    asked = spark.createDataFrame([("q", "What about calibration?")], "query_id string, question string")
    assert bm25.hits(bm25.build_retriever(docs), asked, bm25.RetrievalConfig()).first()["doc_id"] == "DOC-A"


def test_a_stored_index_gives_the_same_hits(spark, tmp_path):
    docs = bundles.load_corpus(spark, corpus(tmp_path / "c"))
    index = bm25.build_retriever(docs)
    asked = spark.createDataFrame([("q", "What about calibration?"), ("r", "cleaning or storing?")], "query_id string, question string")
    bm25.save(index, str(tmp_path / "index"))
    want = sorted(map(str, bm25.hits(index, asked, bm25.RetrievalConfig()).collect()))
    index.release()
    got = sorted(map(str, bm25.hits(bm25.load(spark, str(tmp_path / "index")), asked, bm25.RetrievalConfig()).collect()))
    assert got == want and got


def write(name, content):
    return lambda side, at: (at / name).write_bytes(content)


@pytest.mark.parametrize(
    "change, path, message",
    [
        (lambda s, _: s.pop("status"), "metadata/A.yaml", "status: field required"),
        (lambda s, _: s.update(extra=1), "metadata/A.yaml", "extra: unknown field"),
        (lambda s, _: s.update(status="Secret"), "metadata/A.yaml", "status: unknown value"),
        (lambda s, _: s.update(source_file_path="../A.md"), "metadata/A.yaml", "must stay inside"),
        (lambda s, _: s.update(source_file_path="documents/none.md"), "metadata/A.yaml", "source file not found"),
        (write("documents/A.md", b"changed"), "metadata/A.yaml", "source_hash does not match"),
        (lambda s, at: (write("documents/A.md", b" \n")(s, at), s.update(source_hash="sha256:" + hashlib.sha256(b" \n").hexdigest())), "documents/A.md", "must not be empty"),
        (lambda s, at: (write("documents/A.md", b"\xff\xfe")(s, at), s.update(source_hash="sha256:" + hashlib.sha256(b"\xff\xfe").hexdigest())), "metadata/A.yaml", "UTF-8"),
        (lambda s, at: (at / "metadata/C.yaml").write_text("a: [1"), "metadata/C.yaml", "invalid YAML"),
        (lambda s, at: (at / "metadata/C.yaml").write_text(""), "metadata/C.yaml", "field required"),
        (lambda s, at: (write("documents/A.md", b"")(s, at), s.update(source_hash="sha256:" + hashlib.sha256(b"").hexdigest())), "documents/A.md", "must not be empty"),
    ],
)
def test_issues(spark, tmp_path, change, path, message):
    with pytest.raises(CorpusInvalid) as e:
        bundles.load_corpus(spark, corpus(tmp_path, change))
    assert [i["path"] for i in e.value.issues] == [path] and message in e.value.issues[0]["message"]


def test_duplicate_current_versions(spark, tmp_path):
    def twice(side, at):
        (at / "metadata/AA.yaml").write_text(yaml.safe_dump(side | {"version": "2.0"}))

    docs, issues = bundles.read_corpus(spark, corpus(tmp_path, twice))
    assert docs.count() == 6 and "(versions: 1.0, 2.0)" in issues.first()["message"]


def test_no_sidecars(spark, tmp_path):
    """A corpus without metadata is invalid; that is a result, not an error."""
    from attesta.plans import service

    for folder, told in ((tmp_path / "none", "directory is required"), (tmp_path / "empty", "at least one")):
        (folder / ("metadata" if "least" in told else "documents")).mkdir(parents=True)
        with pytest.raises(CorpusInvalid):
            bundles.load_corpus(spark, str(folder))
        report = service.Service(spark, {"main": str(folder)}).validate_corpus()
        assert not report["valid"] and report["metadata_files_seen"] == 0 and told in report["issues"][0]["message"]


def messy(tmp_path):
    (tmp_path / "incoming/documents").mkdir(parents=True)
    files = {
        "SOP-1_v1.0.md": "Status: in force\n\n# A\n\ntext one", "SOP-2_v2.0.md": "text two", "SOP-3_v1.0.md": "  ",
        "free.md": "no name", "SOP-4_v1.0.md": "x", "SOP-5_v1.0.md": "a", "SOP-5_v2.0.md": "b",
    }
    for name, text in files.items():
        (tmp_path / f"incoming/documents/{name}").write_text(text)
    base = {"doc_title": "T", "doc_type": "procedure", "effective_date": "2024-01-01", "department": "QA"}
    at = lambda n, **more: {"source_path": f"incoming/documents/{n}", **base, **more}
    register = [
        at("SOP-1_v1.0.md", version="rev-1.0"), at("SOP-2_v2.0.md", version="1.0", status="approved"),
        at("SOP-3_v1.0.md", status="approved"), at("SOP-4_v1.0.md", status="odd"), at("SOP-4_v1.0.md", status="draft"),
        at("SOP-5_v1.0.md", status="approved"), at("SOP-5_v2.0.md", status="approved"), at("gone.md", doc_id="G", version="1", status="draft"),
        {"source_path": "../outside.md"},
    ]
    (tmp_path / "incoming/source-register.yaml").write_text(yaml.safe_dump({"records": register}))
    mapping = {
        "schema_version": "1", "client_label": "x", "status_map": {"in force": "Effective", "approved": "Approved", "draft": "Draft"},
        "doc_type_map": {"procedure": "SOP"},
        "filename_patterns": [{"name": "n", "pattern": r"^(?P<doc_id>[A-Z]+-\d+)_v(?P<version>[\d.]+)\.md$"}],
        "header_fields": {"status": "Status"},
    }
    (tmp_path / "metadata-map.yaml").write_text(yaml.safe_dump(mapping))
    return str(tmp_path)


def test_onboarding(spark, tmp_path):
    sources, mapping = bundles.read_bundle(spark, messy(tmp_path / "in"))
    sources = sources.cache()
    records = onboarding.review_duplicates(onboarding.evaluate_sources(sources, mapping)).cache()
    got = {r["source_path"].rsplit("/", 1)[-1]: r for r in records.collect()}
    state = {k: r["state"] for k, r in got.items()}
    assert state == {
        "SOP-1_v1.0.md": "mapped_cleanly", "SOP-2_v2.0.md": "needs_review", "SOP-3_v1.0.md": "rejected", "free.md": "rejected",
        "SOP-4_v1.0.md": "excluded", "SOP-5_v1.0.md": "needs_review", "SOP-5_v2.0.md": "needs_review", "gone.md": "rejected",
        "outside.md": "rejected",
    }
    assert got["SOP-2_v2.0.md"]["reasons"] == ["conflicting_field_sources:version", "missing_required_field:version"]
    assert got["SOP-1_v1.0.md"]["field_sources"]["status"] == "header" and got["SOP-1_v1.0.md"]["field_sources"]["version"] == "filename"
    assert got["outside.md"]["reasons"] == ["unsafe_source_path"] and got["SOP-5_v1.0.md"]["reasons"] == ["duplicate_current_version"]
    assert set(got["gone.md"]["reasons"]) == {"source_file_not_found", "empty_source_text"}
    report = sinks.onboarding_report(records, "in")
    assert report["state_counts"] == {"mapped_cleanly": 1, "excluded": 1, "needs_review": 3, "rejected": 4}
    assert report["emitted_document_count"] == 2 and report["field_coverage"]["doc_id"]["missing"] == 2
    text = sinks.onboarding_markdown(report)
    assert "- `mapped_cleanly`: 1" in text and "SOP-2_v2.0.md" in text
    out = str(tmp_path / "out")
    clean = sinks.normalized_corpus(records, sources)
    assert [*sinks.write_bundle(clean, out).values()] == ["metadata/SOP-1_v1.0.yaml", "metadata/SOP-4_v1.0.yaml"]
    assert bundles.load_corpus(spark, out).count() == 2
    with pytest.raises(bundles.BundleError):
        sinks.write_bundle(clean, out)
    sinks.write_bundle(clean, out, force=True)
    (tmp_path / "table").mkdir()
    sinks.write_normalized(clean, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_suites_and_fixtures(spark, tmp_path):
    docs = bundles.load_corpus(spark, corpus(tmp_path / "c"))
    case = {
        "case_id": "one", "question": "What about calibration?", "expected_outcome": "answer",
        "expected_source_doc_ids": ["DOC-A"], "forbidden_doc_ids": ["DOC-B"],
        "answer_fixture": {"answer_text": "x", "citations": [{"chunk_id": "DOC-A_v1_0_chunk_001", "label": "1"}], "expected_outcome": "answer"},
        "expected_citation_resolves_to_retrieved_chunk": True,
    }
    path = str(tmp_path / "suite.json")
    (tmp_path / "suite.json").write_text(json.dumps({"suite_name": "s", "cases": [case]}, indent=1))
    results, metrics = evaluation.evaluate(bm25.build_retriever(docs), bundles.read_suite(spark, path))
    assert results.first()["passed"] and metrics.first()["case_pass_rate"] == "1/1"
    summary = {"corpus_dir": "c", "metadata_files_seen": 5, "documents_valid": 5, "documents_retrievable": 4, "documents_excluded": 1}
    report = sinks.evaluation_report("s", summary, bm25.RetrievalConfig().record(), metrics.first().asDict(), [results.first().asDict()])
    assert list(report)[:3] == ["valid", "trust_layer_status", "suite_name"] and report["cases"][0]["generated_answer_outcome_passed"]
    text = sinks.evaluation_markdown(report)
    assert "- `case_pass_rate`: 1/1" in text and "| `one` | true | answer | DOC-A_v1_0_chunk_001 | none | true | none |" in text
    assert [x for x in text.splitlines() if x.startswith("## ")] == ["## Summary", "## Corpus/config", "## Metrics", "## Case table", "## Limits"]
    (tmp_path / "suite.json").write_text(json.dumps({"suite_name": "s", "cases": [case | {"expected_outcome": "refusal"}]}))
    with pytest.raises(bundles.BundleError):
        bundles.read_suite(spark, path)
    (tmp_path / "r.json").write_text(json.dumps({"query": "q", "hits": [{"chunk_id": "a", "status": "Approved", "extra": 1}]}))
    (tmp_path / "a.json").write_text(json.dumps({"answer_text": "t", "citations": [{"chunk_id": "a", "label": None}], "expected_outcome": "answer"}))
    from attesta.operators.answers import validate_citations

    both = bundles.read_retrieval(spark, str(tmp_path / "r.json")).crossJoin(bundles.read_answer(spark, str(tmp_path / "a.json")))
    assert validate_citations(both).first()["valid"]


def test_exports(spark, tmp_path):
    from attesta.operators.chunking import chunk_documents

    docs = bundles.load_corpus(spark, corpus(tmp_path / "c"))
    chunks = chunk_documents(docs)
    held = chunk_documents(docs, gate=False).filter("status = 'Draft'")
    (tmp_path / "x.json").write_text(sinks.demo_export(chunks, held, docs))
    got = bundles.read_exported_chunks(spark, str(tmp_path / "x.json"))
    assert [(r["chunk_id"], r["held_out"]) for r in got.orderBy("chunk_id").collect()][:2] == [("DOC-A_v1_0_chunk_001", False), ("DOC-B_v1_0_chunk_001", True)]
    page = spark.createDataFrame([('<b data-q="a &amp; b">x</b><i data-q="c &quot;d&quot;">',)], "html string")
    assert [r["question"] for r in bundles.scrape_questions(page).collect()] == ["a & b", 'c "d"']
    asked = spark.createDataFrame([("a", 2), ("b", 0), ("a", 1)], "question string, position int")
    assert sorted(map(tuple, bundles.first_of_each(asked).collect())) == [("a", 1), ("b", 0)]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "tier": "easy", "relevant_doc": None, "query": "x"}]))
    assert bundles.read_labelled_queries(spark, str(tmp_path / "q.json")).first()["tier"] == "easy"
    assert bundles.corpus_registry(spark, "a=/x, b=/y") == {"a": "/x", "b": "/y"}
    with pytest.raises(bundles.BundleError):
        bundles.corpus_registry(spark, "a=/x,a=/y")


def test_audit_lines_append(spark, tmp_path):
    at = str(tmp_path / "audit")
    line = spark.createDataFrame([("r1", "answer", "refusal")], "request_id string, endpoint string, outcome string")
    sinks.append_audit(line, at)
    sinks.append_audit(line, at)
    rows = spark.read.text(at).collect()
    assert len(rows) == 2 and list(json.loads(rows[0][0])) == ["endpoint", "outcome", "request_id"]


def test_audit_stream_agrees_with_a_batch(spark):
    stream = audit.counts(audit.events(spark, "/root/testdata/sf0.001"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("audit_counts").start()
    query.processAllAvailable()
    query.stop()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = events.groupBy(F.date_trunc("hour", "ts"), "event_type").count().count()
    got = spark.sql("SELECT count(*), sum(n) FROM audit_counts").first()
    assert tuple(got) == (want, events.count())


def test_service(spark, tmp_path):
    from attesta.plans import service

    at = corpus(tmp_path / "c")
    audit_path = str(tmp_path / "audit")
    calls = service.Service(spark, f"main={at}", api_key="k", audit_path=audit_path)
    assert calls.health() == {"status": "ok", "corpora": ["main"]}
    report = calls.validate_corpus(key="k")
    assert report["valid"] and report["documents_retrievable"] == 4 and report["metadata_files_seen"] == 5
    found = calls.retrieve("What about calibration?", key="k")
    assert found["hits"][0]["doc_id"] == "DOC-A" and set(found["hits"][0]) == set(service.HIT)
    # only a draft speaks of B
    held = calls.retrieve("zebra unicorn B", key="k")
    assert not held["hits"]
    told = calls.answer("What about calibration?", key="k")
    assert told["outcome"] == "answer" and told["valid"] and told["citations"][0]["chunk_id"] == "DOC-A_v1_0_chunk_001"
    assert calls.answer("zebra unicorn", key="k")["review_reasons"] == ["refusal_no_supporting_documents"]
    with pytest.raises(service.Unauthorized):
        calls.retrieve("x", key="wrong")
    with pytest.raises(service.UnknownCorpus):
        calls.retrieve("x", corpus="other", key="k")
    lines = [json.loads(r[0]) for r in spark.read.text(audit_path).collect()]
    assert len(lines) == 7 and {r["outcome"] for r in lines} == {"ok", "answer", "refusal", "unauthorized", "unknown_corpus"}
    case = {"case_id": "one", "question": "What about calibration?", "expected_outcome": "answer", "expected_source_doc_ids": ["DOC-A"]}
    (tmp_path / "s.json").write_text(json.dumps({"suite_name": "s", "cases": [case]}))
    assert calls.evaluate(str(tmp_path / "s.json"), key="k")["metrics"]["case_pass_rate"] == "1/1"


def test_onboard_call(spark, tmp_path):
    from attesta.plans import service

    at = messy(tmp_path / "in")
    report = service.onboard(spark, at, str(tmp_path / "out"), dry_run=True)
    assert report["emitted_document_count"] == 2 and not (tmp_path / "out").exists()
    service.onboard(spark, at, str(tmp_path / "out"))
    assert bundles.load_corpus(spark, str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize(
    "content, told",
    [
        (b"{not json", "invalid JSON"), (b"\xff", "UTF-8"), (b"[]", "object"), (b'{"suite_name": "s", "cases": []}', "no cases"),
        (b'{"cases": [{"case_id": "a", "question": "q", "expected_outcome": "answer"}]}', "suite_name: field required"),
        (b'{"suite_name": "s", "cases": [{"case_id": "a", "question": "q", "expected_outcome": "maybe"}]}', "expected_outcome"),
        (b'{"suite_name": "s", "cases": [{"case_id": "a", "question": "q", "expected_outcome": "answer", "top_k": 0}]}', "top_k"),
        (b'{"suite_name": "s", "cases": [{"case_id": "a", "question": "q", "expected_outcome": "answer", "more": 1}]}', "more: unknown field"),
        (b'{"suite_name": "s", "cases": [{"case_id": "a", "question": "q", "expected_outcome": "answer", "answer_fixture": {"answer_text": ""}}]}', "answer_text"),
    ],
)
def test_broken_suites_raise(spark, tmp_path, content, told):
    (tmp_path / "s.json").write_bytes(content)
    with pytest.raises(bundles.BundleError, match=told):
        bundles.read_suite(spark, str(tmp_path / "s.json"))


def test_broken_fixtures_raise(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"hits": [{"chunk_id": "a", "status": "Secret"}]}))
    (tmp_path / "a.json").write_text(json.dumps({"answer_text": "t", "citations": [{"chunk_id": ""}], "expected_outcome": "answer"}))
    for read, name in ((bundles.read_retrieval, "r"), (bundles.read_answer, "a"), (bundles.read_answer, "none")):
        with pytest.raises(bundles.BundleError):
            read(spark, str(tmp_path / f"{name}.json"))


def test_links_that_lead_outside(spark, tmp_path):
    at = corpus(tmp_path / "c")
    secret = tmp_path / "secret.md"
    secret.write_bytes((tmp_path / "c/documents/A.md").read_bytes())
    (tmp_path / "c/documents/A.md").unlink()
    (tmp_path / "c/documents/A.md").symlink_to(secret)
    _, issues = bundles.read_corpus(spark, at)
    assert [(r["path"], "stay inside" in r["message"]) for r in issues.collect()] == [("metadata/A.yaml", True)]
    at = messy(tmp_path / "in")
    (tmp_path / "in/incoming/documents/SOP-6_v1.0.md").symlink_to(secret)
    sources, _ = bundles.read_bundle(spark, at)
    safe = {r["source_path"].rsplit("/", 1)[-1]: r["safe"] for r in sources.collect()}
    assert {k for k, v in safe.items() if not v} == {"outside.md", "SOP-6_v1.0.md"}


def test_paths_below_a_folder(spark):
    paths = ["a/b/x", "a/b", "/a/b/x", "a/./b/../b/x", "a/b/../x", "../a/b/x", "a/../../a/b/x", "", None, "c/../a/b//x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(bundles._below(F.col("p"), "a/b")).collect()]
    assert got == [p is not None and bundles.is_inside(p, "a/b") for p in paths]


def test_a_source_that_is_not_utf8_is_rejected(spark, tmp_path):
    at = messy(tmp_path / "in")
    (tmp_path / "in/incoming/documents/SOP-1_v1.0.md").write_bytes(b"\xff\xfe text")
    sources, mapping = bundles.read_bundle(spark, at)
    got = {r["source_path"].rsplit("/", 1)[-1]: r for r in onboarding.evaluate_sources(sources, mapping).collect()}
    assert got["SOP-1_v1.0.md"]["state"] == "rejected" and "empty_source_text" in got["SOP-1_v1.0.md"]["reasons"]


def test_onboarding_report_names_its_inputs_and_outputs(spark, tmp_path):
    from attesta.plans import service

    at = messy(tmp_path / "in")
    other = tmp_path / "map.yaml"
    other.write_text((tmp_path / "in/metadata-map.yaml").read_text() + "\n")
    report = service.onboard(spark, at, str(tmp_path / "out"), mapping_path=str(other))
    assert report["mapping_config_hash"] == "sha256:" + hashlib.sha256(other.read_bytes()).hexdigest()
    assert report["source_register_hash"] == "sha256:" + hashlib.sha256((tmp_path / "in/incoming/source-register.yaml").read_bytes()).hexdigest()
    told = {r["source_path"].rsplit("/", 1)[-1]: r.get("emitted_metadata_path") for r in report["records"]}
    assert told["SOP-1_v1.0.md"] == "metadata/SOP-1_v1.0.yaml" and told["gone.md"] is None
    dry = service.onboard(spark, at, None, dry_run=True)
    assert dry["emitted_document_count"] == 2 and not any("emitted_metadata_path" in r for r in dry["records"])


def test_generated_answers_whose_citations_fail_are_issues(spark, tmp_path, monkeypatch):
    docs = bundles.load_corpus(spark, corpus(tmp_path / "c"))
    real = evaluation.extractive_answers
    stale = "array<struct<chunk_id:string,status:string>>"
    monkeypatch.setattr(
        evaluation, "extractive_answers",
        lambda *a: real(*a).withColumn("retrieved", F.transform("retrieved", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), F.lit("Draft").alias("status"))).cast(stale)),
    )
    case = {
        "case_id": "one", "question": "What about calibration?", "expected_outcome": "answer",
        "answer_fixture": {"answer_text": "x", "citations": [{"chunk_id": "none"}], "expected_outcome": "answer"},
        "expected_citation_resolves_to_retrieved_chunk": True,
    }
    (tmp_path / "s.json").write_text(json.dumps({"suite_name": "s", "cases": [case]}))
    row = evaluation.run_cases(bm25.build_retriever(docs), bundles.read_suite(spark, str(tmp_path / "s.json")), bm25.RetrievalConfig()).first()
    assert row["generated_outcome"] is None and not row["outcome_passed"] and not row["passed"]
    assert any(x.startswith("generated_answer_citation_validation_failed:") for x in row["issues"])
    assert any(x.startswith("citation_expectation_mismatch:expected_resolves=True,observed_resolves=False,expected_codes=[],observed_codes=['") for x in row["issues"])


def test_commands(spark, tmp_path, capsys):
    from attesta.cli import main

    run = lambda *a: (main([str(x) for x in a], spark), *capsys.readouterr())
    at = corpus(tmp_path / "c")
    code, out, _ = run("validate-corpus", at)
    assert code == 0 and "Documents retrievable: 4" in out
    code, out, _ = run("retrieve", at, "--query", "What about calibration?", "--json")
    assert code == 0 and json.loads(out)["hits"][0]["doc_id"] == "DOC-A" and json.loads(out)["retrievable_documents"] == 4
    code, out, _ = run("retrieve", at, "--query", "zebra")
    assert code == 0 and "No retrievable chunks" in out
    code, out, _ = run("answer", at, "--query", "What about calibration?")
    assert code == 0 and json.loads(out)["outcome"] == "answer"
    case = {"case_id": "one", "question": "What about calibration?", "expected_outcome": "answer", "expected_source_doc_ids": ["DOC-A"]}
    (tmp_path / "s.json").write_text(json.dumps({"suite_name": "mine", "cases": [case, case | {"case_id": "a", "expected_source_doc_ids": ["NO"]}]}))
    code, out, err = run("evaluate", at, tmp_path / "s.json", "--json-out", tmp_path / "e.json", "--markdown-out", tmp_path / "e.md")
    assert code == 1 and "Cases passed: 1/2" in out and "evaluation failed" in err
    report = json.loads((tmp_path / "e.json").read_text())
    assert [c["case_id"] for c in report["cases"]] == ["one", "a"] and list(report)[0] == "valid"
    assert "expected_source_doc_missing:NO" in (tmp_path / "e.md").read_text()
    (tmp_path / "r.json").write_text(json.dumps({"hits": [{"chunk_id": "a", "status": "Approved"}]}))
    (tmp_path / "a.json").write_text(json.dumps({"answer_text": "t", "citations": [{"chunk_id": "b"}], "expected_outcome": "answer"}))
    code, out, _ = run("validate-citations", tmp_path / "r.json", tmp_path / "a.json")
    assert code == 1 and "- unresolved_citation" in out
    bundle = messy(tmp_path / "in")
    code, out, _ = run("onboard-corpus", bundle, "--output", tmp_path / "out", "--report-out", tmp_path / "o.json", "--markdown-out", tmp_path / "o.md", "--require-no-review")
    assert code == 1 and "mapped_cleanly: 1" in out and json.loads((tmp_path / "o.json").read_text())["emitted_document_count"] == 2
    code, _, err = run("onboard-corpus", bundle, "--output", tmp_path / "out", "--report-out", tmp_path / "o.json")
    assert code == 2 and "not empty" in err
    (tmp_path / "c/documents/A.md").write_text("changed")
    code, _, err = run("retrieve", at, "--query", "x")
    assert code == 1 and "source_hash does not match" in err
    assert run("validate-corpus", at)[0] == 1


def test_comparison_report():
    one = {"recall_at_1": 0.5, "recall_at_3": 0.75, "recall_at_5": 1.0, "mrr": 0.6, "n": 4}
    apart = {"min_on_topic": 2.0, "max_off_topic": 1.0, "clean": True, "midpoint": 1.5}
    text = sinks.comparison_markdown({
        "n_chunks": 9, "model": "m", "metrics": {"all": {"bm25": one, "semantic": one | {"mrr": 0.9}}},
        "separation": {"bm25": apart | {"clean": False, "midpoint": None}, "semantic": apart},
        "gate": {"refused_off_topic": 2, "n_off_topic": 2, "refused_on_topic": 1, "n_on_topic": 4},
        "queries": [{"id": "h1", "tier": "hard", "ranks": {"bm25": None, "semantic": 2}}],
    })
    assert "| bm25 | 0.50 | 0.75 | 1.00 | 0.60 |" in text and "| h1 | - | 2 |" in text and "Best on hard queries: semantic" in text
    assert "semantic (at 1.50)" in text and "refuses 2/2" in text
