"""Audit lines exactly once, and a service whose indexes outlive its session."""

import json

import pytest

from attesta.operators import bm25, postings
from attesta.plans import service
from attesta.streaming import audit
from tests.test_bundles import corpus


def lines(spark, log):
    return sorted(r[0] for r in audit.recorded(spark, log).collect())


def spool_of(tmp_path, ids):
    for i in ids:
        audit.note(str(tmp_path / "spool"), {"request_id": f"r{i}", "outcome": "ok", "endpoint": "é"})


def test_lines_are_recorded_once(spark, tmp_path):
    """By batches, by several sessions, with lines put twice and nothing new."""
    spool, log = str(tmp_path / "spool"), str(tmp_path / "log")
    assert lines(spark, log) == []
    spool_of(tmp_path, range(10))
    audit.record(spark, spool, log, files=4).awaitTermination()
    spool_of(tmp_path, [3, 10, 11])
    for _ in range(2):
        audit.record(spark, spool, log).awaitTermination()
    got = lines(spark, log)
    assert sorted(json.loads(x)["request_id"] for x in got) == sorted(f"r{i}" for i in range(12))
    assert got[0] == '{"endpoint": "é", "outcome": "ok", "request_id": "r0"}'
    files = [f for f in (tmp_path / "log").glob("batch-*/part-*") if f.stat().st_size]
    assert len(files) < 12  # several lines each


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "value string")
    audit.keep_batch(batch, 0, log)
    audit.keep_batch(batch, 0, log)
    assert lines(spark, log) == ["a", "a", "b"]
    half = tmp_path / "log" / f"batch-{1:012d}"  # what a killed session leaves
    half.mkdir()
    (half / "part-0.txt").write_text("a\nhal")
    assert lines(spark, log) == ["a", "a", "b"]
    audit.keep_batch(batch, 1, log)
    assert lines(spark, log) == ["a", "a", "a", "a", "b", "b"]


def test_a_batch_that_fails_is_repeated(spark, tmp_path, monkeypatch):
    """The write goes through, the session ends before the stream knows."""
    spool, log, keep = str(tmp_path / "spool"), str(tmp_path / "log"), audit.keep_batch
    spool_of(tmp_path, range(5))

    def killed(batch, number, at):
        keep(batch, number, at)
        raise RuntimeError("killed")

    monkeypatch.setattr(audit, "keep_batch", killed)
    with pytest.raises(Exception, match="killed"):
        audit.record(spark, spool, log).awaitTermination()
    monkeypatch.setattr(audit, "keep_batch", keep)
    audit.record(spark, spool, log).awaitTermination()
    assert len(lines(spark, log)) == 5


def test_service_spools_and_stores(spark, tmp_path, monkeypatch):
    at, indexes, spool, log = corpus(tmp_path / "c"), str(tmp_path / "i"), str(tmp_path / "spool"), str(tmp_path / "log")
    asked = "What about calibration?"
    plain = service.Service(spark, {"main": at}).retrieve(asked)
    assert service.Service(spark, {"main": at}, indexes=indexes, spool=spool).retrieve(asked) == plain and plain["hits"]
    build = bm25.build_retriever
    monkeypatch.setattr(bm25, "build_retriever", lambda *a, **k: pytest.fail("built again"))
    calls = service.Service(spark, {"main": at}, indexes=indexes, spool=spool)
    assert calls.retrieve(asked) == plain
    assert isinstance(calls._index("main"), postings.Stored)
    with pytest.raises(service.UnknownCorpus):
        calls.retrieve(asked, corpus="other")
    audit.record(spark, spool, log).awaitTermination()
    assert [json.loads(x)["outcome"] for x in lines(spark, log)].count("ok") == 2 and len(lines(spark, log)) == 3
    monkeypatch.setattr(bm25, "build_retriever", build)
    # the corpus as it is now has an index of its own
    side = tmp_path / "c/metadata/A.yaml"
    side.write_text(side.read_text().replace("doc_title: A", "doc_title: Heading"))
    again = service.Service(spark, {"main": at}, indexes=indexes).retrieve(asked)
    assert plain["hits"][0]["doc_title"] == "A" and again["hits"][0]["doc_title"] == "Heading"
