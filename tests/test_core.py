import math
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import answers, bm25, chunking, evaluation, ranking, validation
from attesta.vocabulary import REFUSAL_TEXT, RetrievalConfig

SCHEMA = (
    "doc_id string, doc_title string, doc_type string, version string, status string, department string, "
    "source_file_path string, source_hash string, raw_text string"
)
ODD_TEXT = "intro line\r\nsecond\rthird\n\n#  Head ing  \nbody\x0cmore\n \t\nlast tail\n####### not\n#none\n# End"


@pytest.fixture(scope="module")
def documents(spark):
    texts = {
        "A": ("Approved", "1.0", "# Monitoring\n\nThe balance is checked daily with weights.\n\nRecords are kept for the balance.\n"),
        "B": ("Effective", "2.1", "# Cleaning\n\nThe room is cleaned daily by the staff.\n# Waste\nWaste leaves the room daily."),
        "C": ("Draft", "0.1", "# Draft balance\n\nThe balance balance balance may be checked hourly with weights.\n"),
        "D": ("Obsolete", "0-1", "Old balance weights were checked monthly."),
        "E": ("Approved", "1", "\n\n"), "F": ("Approved", "1", "# Only\n## Headings"), "G": ("Approved", "1", None),
        "H": ("Approved", "v 1/2", ODD_TEXT),
    }
    rows = [
        (k, f"Title {k}", "SOP", v, s, "QA", f"documents/{k}.md", "x", t) for k, (s, v, t) in texts.items()
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_chunks(text, title):
    """Paragraphs as a loop over lines."""
    text = re.sub("\r\n?", "\n", text)
    lines, offset, out, heading, run = text.splitlines(keepends=True), 0, [], title, None
    for n, raw in enumerate(lines, 1):
        line = raw.splitlines()[0] if raw.splitlines() else ""
        m = re.match(r"^#{1,6}\s+(.+?)\s*$", line)
        if m or not line.strip():
            run = None
            heading = m[1].strip() if m else heading
        else:
            if run is None:
                run = [n, n, offset, 0, heading]
                out.append(run)
            run[1], run[3] = n, offset + len(line)
        offset += len(raw)
    return [(a, b, s, e, h, text[s:e]) for a, b, s, e, h in out]


def test_chunks_follow_a_loop_over_lines(documents):
    chunks = chunking.chunk_documents(documents, gate=False).orderBy("doc_id", "chunk_index").collect()
    got = {}
    for c in chunks:
        a, b = map(int, re.match(r"lines (\d+)-(\d+)", c["line_or_page_span"]).groups())
        got.setdefault(c["doc_id"], []).append((a, b, c["char_start"], c["char_end"], c["section_heading"], c["text"]))
    for d in documents.collect():
        want = plain_chunks(d["raw_text"] or "", d["doc_title"])
        assert got.get(d["doc_id"], []) == want, d["doc_id"]
    assert [c["chunk_id"] for c in chunks if c["doc_id"] == "H"][0] == "H_vv_1_2_chunk_001"


def test_gate_stands_before_chunks(documents):
    assert {c["status"] for c in chunking.chunk_documents(documents).collect()} == {"Approved", "Effective"}


def test_long_numbers_are_not_cut(spark):
    at = spark.range(1).select(T.chunk_id(F.lit("X"), F.lit("1.0"), F.lit(1000)).alias("a"), T.chunk_id(F.lit("X"), F.lit("__"), F.lit(7)).alias("b"))
    assert tuple(at.first()) == ("X_v1_0_chunk_1000", "X_v_chunk_007")


QUESTIONS = {
    "q1": "How is the balance checked daily?", "q2": "balance balance weights", "q3": "the of and", "q4": "",
    "q5": "zebra crossing unicorn daily", "q6": "the balance weights monthly",
}


def plain_bm25(chunks, question):
    tokenize = lambda t: re.findall(r"\w+", t.lower())
    docs = [tokenize(f"{c['section_heading']}\n{c['text']}") for c in chunks]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    vocabulary = {t for d in docs for t in d}
    df = {t: sum(t in d for d in docs) for t in vocabulary}
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for c, d in zip(chunks, docs):
        s = 0.0
        for t in tokenize(question):
            f = d.count(t)
            s += idf.get(t, 0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / mean))
        out.append((c, s))
    return sorted([x for x in out if x[1] > 0], key=lambda x: (-x[1], x[0]["doc_id"], x[0]["chunk_index"]))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUESTIONS.items()), "query_id string, question string")


@pytest.mark.parametrize("gate", [True, False])
def test_scores_follow_the_formula(documents, queries, gate):
    index = bm25.build_retriever(documents, gate=gate)
    got = {}
    for r in bm25.hits(index, queries, RetrievalConfig(top_k=50), gate=False).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    chunks = chunking.chunk_documents(documents, gate).collect()
    for q, text in QUESTIONS.items():
        want = [(c["chunk_id"], s) for c, s in plain_bm25(chunks, text)]
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in want]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got.get(q, []), want))


def test_gate_looks_at_the_best_hit_after_the_cut(documents, queries):
    index = bm25.build_retriever(documents)
    found = bm25.hits(index, queries, RetrievalConfig(top_k=2, min_top_coverage=0.6)).collect()
    assert {r["query_id"] for r in found} == {"q1", "q2", "q6"} or {r["query_id"] for r in found} == {"q1", "q2"}
    # words that aren't content never pass, however well they score
    assert "q3" not in {r["query_id"] for r in found} and "q5" not in {r["query_id"] for r in found}
    free = bm25.hits(index, queries, RetrievalConfig(min_top_coverage=0.0)).collect()
    assert {"q3", "q5"} & {r["query_id"] for r in free}


def test_held_out_hits_keep_their_ranks(documents, queries):
    blind = bm25.build_retriever(documents, gate=False)
    all_ = {(r["query_id"], r["rank"]): r for r in bm25.hits(blind, queries, RetrievalConfig(top_k=3), gate=False).collect()}
    held = bm25.held_out(blind, queries, RetrievalConfig(top_k=3)).collect()
    assert held and all(all_[r["query_id"], r["rank"]]["chunk_id"] == r["chunk_id"] for r in held)
    assert {r["status"] for r in held} <= {"Draft", "Obsolete"}
    best = bm25.best_per_document(bm25.held_out(blind, queries, RetrievalConfig(top_k=20))).collect()
    assert len({(r["query_id"], r["doc_id"]) for r in best}) == len(best)


def test_result_does_not_depend_on_partitions(documents, queries):
    out = []
    for n in (1, 8):
        index = bm25.build_retriever(documents.repartition(n))
        out.append(bm25.hits(index, queries, RetrievalConfig()).orderBy("query_id", "rank").select("chunk_id", "score").collect())
    assert out[0] == out[1]


def test_config_is_checked():
    for bad in ({"top_k": 0}, {"score_floor": -1}, {"min_top_coverage": 1.5}, {"method": "dense"}):
        with pytest.raises(ValueError):
            RetrievalConfig(**bad)


def test_answers_and_refusals(documents, queries):
    found = bm25.hits(bm25.build_retriever(documents), queries, RetrievalConfig(top_k=2))
    got = {r["query_id"]: r for r in answers.checked_answers(queries, found).collect()}
    assert set(got) == set(QUESTIONS)
    assert got["q4"]["answer_text"] == REFUSAL_TEXT and not got["q4"]["citations"] and got["q4"]["outcome"] == "refusal"
    assert got["q1"]["answer_text"].startswith("[source: 1] A v1.0, Monitoring, lines 3-3\nThe balance is checked")
    assert [c["label"] for c in got["q1"]["citations"]] == ["1", "2"] and all(r["valid"] for r in got.values())
    routed = {r["query_id"]: r["review_reasons"] for r in answers.route_review(answers.extractive_answers(queries, found), 0.0, 0.1).collect()}
    assert routed["q4"] == ["refusal_no_supporting_documents"] and routed["q1"] == []


def test_citation_traps(spark):
    hit = [("c1", "Approved"), ("c2", "Draft")]
    rows = [
        ("valid", "answer", [("c1", "1")], [("c1", "Approved")], True, []),
        ("missing", "answer", [], [("c1", "Approved")], False, ["missing_answer_citation"]),
        ("invented", "answer", [("zz", "1")], [("c1", "Approved")], False, ["unresolved_citation"]),
        ("stale", "answer", [("c2", "1")], hit, True, ["stale_retrieved_chunk", "stale_citation"]),
        ("refusal", "refusal", [], [], True, []),
        ("refusal cites", "refusal", [("c1", "1")], [("c1", "Approved")], True, ["refusal_has_citation"]),
        ("last wins", "answer", [("c1", "1")], [("c1", "Draft"), ("c1", "Approved")], True, ["stale_retrieved_chunk"]),
    ]
    schema = f"name string, outcome string, citations {answers.CITATIONS}, retrieved {answers.RETRIEVED}, resolves boolean, codes array<string>"
    for r in answers.validate_citations(spark.createDataFrame(rows, schema)).collect():
        assert r["citation_resolves"] == r["resolves"] and r["issue_codes"] == r["codes"], r["name"]
        assert r["valid"] == (r["resolves"] and not r["codes"])


CASES = (
    "case_id string, question string, expected_outcome string, top_k int, expected_source_doc_ids array<string>, "
    "expected_chunk_ids array<string>, forbidden_doc_ids array<string>, expect_no_hits boolean, fixture_outcome string, "
    f"fixture_citations {answers.CITATIONS}, expected_resolves boolean, expected_issue_codes array<string>"
)


def test_suite(spark, documents):
    rows = [
        ("good", "How is the balance checked daily?", "answer", 3, ["A"], [], ["C"], False, "answer", [("A_v1_0_chunk_001", "1")], True, []),
        ("trap", "balance weights checked", "answer", 3, ["A"], [], [], False, "answer", [("nope", "1")], False, ["unresolved_citation"]),
        ("refuse", "zebra crossing unicorn", "refusal", 3, [], [], [], True, None, None, None, []),
        ("wrong", "How is the balance checked daily?", "refusal", 3, ["Z"], ["none"], ["A"], True, None, None, None, []),
    ]
    index = bm25.build_retriever(documents)
    results, metrics = evaluation.evaluate(index, spark.createDataFrame(rows, CASES))
    got = {r["case_id"]: r for r in results.collect()}
    assert got["good"]["passed"] and got["trap"]["passed"] and got["refuse"]["passed"]
    assert not got["wrong"]["passed"]
    assert got["wrong"]["issues"][:3] == ["expected_source_doc_missing:Z", "expected_chunk_missing:none", "forbidden_doc_retrieved:A"]
    m = metrics.first()
    assert m["case_pass_rate"] == "3/4" and m["refusal_expectation_match_rate"] == "1/2"
    assert m["citation_resolves_to_retrieved_chunk_rate"] == "1/2" and m["citation_expectation_match_rate"] == "2/2"
    none = evaluation.suite_metrics(results.filter("case_id = 'x'")).first()
    assert none["case_pass_rate"] == "n/a"


@pytest.mark.parametrize(
    "value, want",
    [("rev-2.0", "2.0"), ("Rev-A", "A"), ("v1.2", "1.2"), ("V3", "3"), ("version 1", "version 1"), (" v2 ", "2"), ("v", "v")],
)
def test_versions(spark, value, want):
    assert spark.range(1).select(T.normalize_version(F.lit(value))).first()[0] == want


def test_headers(spark):
    text = "status: In force\nSTATUS: Draft: maybe\nOther: x\n\nDepartment: late\n"
    names = {"status": "Status", "department": "Department"}
    head = lambda t: spark.range(1).select(T.header_fields(F.lit(t), names)).first()[0]
    assert head(text) == {"status": "Draft: maybe"}
    assert head("# no\nStatus: x") == {} and head("") == {} and head("no colon\nStatus: x") == {}


def test_tokens_of_other_scripts(spark):
    texts = ["Été à l'École_1", "ΣΑΣ 中文 ٣", "  ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokenize(F.col("t"))).collect()
    assert [r[0] for r in rows] == [re.findall(r"\w+", (t or "").lower()) for t in texts]


def test_metadata_rules(spark):
    good = ("D", "T", "SOP", "1", "Approved", "QA", "sha256:" + "0" * 64, "2024-01-31", None)
    columns = "doc_id doc_title doc_type version status department source_hash effective_date review_due_date".split()
    cases = [
        ({}, None), ({"doc_id": " 　"}, "doc_id"), ({"doc_type": "Memo"}, "doc_type"), ({"status": None}, "status"),
        ({"source_hash": "sha256:" + "0" * 64 + "\n"}, "source_hash"), ({"effective_date": "2024-1-5"}, "effective_date"),
        ({"effective_date": "2024-02-31"}, "effective_date"), ({"review_due_date": "2024-01-30"}, "review_due_date"),
        ({"review_due_date": "2024-01-31"}, None),
    ]
    rows = [tuple({**dict(zip(columns, good)), **c}[k] for k in columns) for c, _ in cases]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    got = [r[0] for r in df.select(validation.metadata_problem()).collect()]
    assert [g and g.split(":")[0] for g in got] == [w for _, w in cases]


def test_rankings(spark):
    scores = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.5), ("q", "c", 0.9)], "query_id string, item_id string, score double")
    ranks = ranking.ranked(scores)
    assert [r["item_id"] for r in ranks.orderBy("rank").collect()] == ["c", "a", "b"]
    fused = ranking.fuse(ranks, ranks).orderBy("rank").first()
    assert fused["item_id"] == "c" and abs(fused["score"] - 2 / 61) < 1e-12
    relevant = spark.createDataFrame([("q", "easy", "a"), ("r", "hard", "z")], "query_id string, tier string, item_id string")
    m = {r["tier"]: r for r in ranking.recall_mrr(ranking.first_relevant(ranks, relevant)).collect()}
    assert m["easy"]["mrr"] == 0.5 and m["hard"]["mrr"] == 0 and m["all"]["mrr"] == 0.25 and m["all"]["recall_at_3"] == 0.5
    top = spark.createDataFrame([("a", True, 3.0, 1.0), ("b", True, 2.0, 0.5), ("c", False, 1.0, 0.2)], "query_id string, on_topic boolean, top_score double, top_coverage double")
    s = ranking.separation(top).first()
    assert s["clean"] and s["midpoint"] == 1.5 and s["refused_on_topic"] == 1 and s["refused_off_topic"] == 1
    best = ranking.best_method(spark.createDataFrame([("hard", "x", 0.4), ("hard", "y", 0.6)], "tier string, method string, mrr double"))
    assert best.first()["method"] == "y"
    v = spark.createDataFrame([("q", [3.0, 4.0], [4.0, 3.0]), ("z", [0.0, 0.0], [1.0, 1.0])], "k string, a array<double>, b array<double>")
    got = [r[0] for r in v.orderBy("k").select(T.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.96) < 1e-12 and got[1] is None


def test_folds_over_many_lines(spark):
    """More paragraphs and lines than a fold gathers at once."""
    from attesta.operators import chunking

    text = "".join(f"# h{i}\n\npara {i}\nmore\n\n" if i % 7 == 0 else f"para {i}\n\n" for i in range(1300)) + "end"
    cols = ("doc_id", "doc_title", "doc_type", "version", "status", "department", "source_file_path", "source_hash", "raw_text")
    doc = spark.createDataFrame([("d", "t", "SOP", "1", "Approved", "QA", "p", "h", text)], list(cols))
    chunks = chunking.chunk_documents(doc).orderBy("chunk_index").collect()
    assert len(chunks) == 1301 and [c["chunk_index"] for c in chunks] == list(range(1, 1302))
    assert all(c["text"] == text[c["char_start"] : c["char_end"]] for c in chunks)
    assert chunks[8]["section_heading"] == "h7" and chunks[-1]["text"] == "end"
    lines = chunking.line_table(doc).orderBy("line_number").collect()
    split = text.split("\n")
    assert len(lines) == len(split) and all(text[r["char_start"] : r["char_start"] + r["n_chars"]] == x for r, x in zip(lines, split))


def test_ranks_over_bands_are_those_of_one_sort(spark):
    import random

    from attesta.operators import ranking

    r = random.Random(3)
    rows = [(q, i, r.choice([0.0, -3.5, r.gauss(0, 1), r.gauss(0, 1e-5), 1e9, 0.25])) for q in "abc" for i in range(200)]
    df = spark.createDataFrame(rows, "query_id string, item_id int, score double")
    want = {}
    for q in "abc":
        own = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))
        want |= {(q, x[1]): k for k, x in enumerate(own, 1)}
    assert {(x["query_id"], x["item_id"]): x["rank"] for x in ranking.ranked(df).collect()} == want
    top = {(x["query_id"], x["item_id"]): x["rank"] for x in ranking.best(df, 9).collect()}
    assert top == {k: v for k, v in want.items() if v <= 9}


def test_records_without_an_id_are_not_reviewed_together(spark):
    from attesta.operators import onboarding

    rows = [
        (None, "Approved", "needs_review", ["x"], False, False), (None, "Approved", "needs_review", ["x"], False, False),
        ("a", "Approved", "mapped_cleanly", [], True, False), ("a", "Effective", "mapped_cleanly", [], True, False),
        ("b", "Approved", "mapped_cleanly", [], True, True), ("b", "Effective", "mapped_cleanly", [], True, False),
        ("c", "Draft", "excluded", [], False, False), ("c", "Approved", "mapped_cleanly", [], True, False),
    ]
    df = spark.createDataFrame(rows, "doc_id string, canonical_status string, state string, reasons array<string>, retrievable boolean, current_version boolean")
    got = sorted(map(str, ((r["doc_id"], r["state"], r["retrievable"]) for r in onboarding.review_duplicates(df).collect())))
    want = [(None, "needs_review", False)] * 2 + [("a", "needs_review", False)] * 2 + [("b", "mapped_cleanly", True)] * 2
    assert got == sorted(map(str, [*want, ("c", "excluded", False), ("c", "mapped_cleanly", True)]))
