"""Documents chunked by segments, against the fold over whole documents."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import chunking, segments

SCHEMA = (
    "doc_id string, doc_title string, doc_type string, version string, status string, department string, "
    "source_file_path string, source_hash string, raw_text string"
)
LINES = ["# One", "##  Two  ", "", " \t", "alpha beta", "gamma", "\x0c", "tail\x0bmore", "#none", "long line of words " * 4, "ü€𝄞 end"]


def text(r):
    return "".join(r.choice(LINES) + r.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(r.randint(0, 40))) + r.choice(["", "end", "# End"])


def document(i, raw, status="Approved", title="T"):
    return (f"D{i}", title, "SOP", "1.0", status, None, f"documents/{i}.md", "x", raw)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    many = [document(i, text(r), r.choice(["Approved", "Effective", "Draft"])) for i in range(60)]
    same = document(100, "# H\n" + "one line\n" * 9 + "\nlast", title=None)
    odd = [document(200, None), document(201, ""), document(202, "\n\n"), document(203, "a\nb\nc\nd"), document(203, "a\nb\nc\nd\ne"), document(204, "# H\n" * 5)]
    return [*many, same, same, same, *odd]


def found(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size, gate", [(1, True), (40, False), (10_000, True)])
def test_segments_give_the_chunks_of_the_fold(spark, rows, size, gate):
    """Repeated rows, one id with two texts, null and empty texts, paragraphs over several borders."""
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit("another")).repartition(3)
    want = found(chunking.chunk_documents(docs, gate))
    assert found(segments.chunk_any(docs, gate, size)) == want and len(want) > 100


def test_no_document_gives_no_chunk(spark, rows):
    docs = spark.createDataFrame(rows[:1], SCHEMA).filter("false")
    assert found(segments.chunk_any(docs, size=5)) == []


@pytest.mark.parametrize("size, span", [(1, 13), (50, 131), (1 << 14, 1 << 20)])
def test_files_are_read_by_ranges(spark, tmp_path, size, span):
    """Ranges that begin inside a character, a line or a line's end; a file that isn't there."""
    r = random.Random(6)
    rows = [document(i, text(r).replace("\r", "\n")) for i in range(8)]
    (tmp_path / "documents").mkdir()
    for row in rows:
        (tmp_path / row[6]).write_text(row[8], encoding="utf-8", newline="")
    docs = spark.createDataFrame([*rows, document(99, None)], SCHEMA)
    got = segments.chunk_segments(segments.read(docs, str(tmp_path), size, span))
    assert found(got) == found(chunking.chunk_documents(docs))


def test_bytes_that_are_no_text_raise(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    (tmp_path / "documents/1.md").write_bytes(b"fine\n\xff\n")
    docs = spark.createDataFrame([document(1, None)], SCHEMA)
    with pytest.raises(Exception, match="not UTF-8"):
        segments.read(docs, str(tmp_path)).collect()


def test_a_long_document_is_many_tasks(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    (tmp_path / "documents/1.md").write_text("# Part\n\nfirst line\nsecond line\n" * 50_000)
    docs = spark.createDataFrame([document(1, None)], SCHEMA)
    parts = segments.read(docs, str(tmp_path), span=1 << 18)
    sizes = [r["n"] for r in parts.select(F.length("text").alias("n")).collect()]
    assert len(sizes) >= 95 and max(sizes) <= segments.SEGMENT + 100
    rows = segments.chunk_segments(parts).select("chunk_index", "line_or_page_span", "char_end", "text").collect()
    last = max(rows)
    assert len(rows) == 50_000 and last["chunk_index"] == 50_000 and last["line_or_page_span"] == "lines 199999-200000"
    assert last["char_end"] == 31 * 50_000 - 1 and {r["text"] for r in rows} == {"first line\nsecond line"}
