"""Chunks of documents of any length, by segments of whole lines that go to as many tasks as there are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import chunk_id, once, unix_lines
from ..sources.store import Store
from .chunking import chunk_documents, paragraphs, status_gate

#: Characters (or bytes of a file) of a segment, about: the line that reaches beyond them is whole. A fold
#: copies what it has found at each line, so short segments are far cheaper than long ones.
SEGMENT = 1 << 14
#: Bytes of a file that a task reads at once.
RANGE = 1 << 23
#: Bytes that a search for the next line reads at a time.
_BLOCK = 1 << 16
DOCUMENT = ("doc_id", "doc_title", "doc_type", "version", "status", "department", "source_file_path", "source_hash")
_KEY = ["_a", "_b"]


def _keys(*content: str) -> dict[str, Column]:
    """Two hashes that name a document, 128 bits together."""
    named = [F.coalesce(F.col(c), F.lit("\0")) for c in (*DOCUMENT, *content)]
    return {"_a": F.xxhash64(*named), "_b": F.xxhash64(F.lit(1), *named)}


def cut(documents: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(fields of DOCUMENT, _a, _b, segment, text): a row for each segment of a document's raw_text, in
    their order. Null and empty texts have none."""
    at = once(documents.select(*DOCUMENT, "raw_text"), text=unix_lines(F.col("raw_text")))
    at = at.withColumns(_keys("raw_text"))
    parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{{size}}}[^\n]*+\n?|.+"), F.lit(0))
    return at.select(*DOCUMENT, *_KEY, F.posexplode(parts).alias("segment", "text")).withColumn("segment", F.col("segment").cast("long"))


def _line_start(f, at: int, size: int) -> int:
    """The first place from `at` on where a line starts."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    place = at - 1
    while place < size:
        f.seek(place)
        block = f.read(min(_BLOCK, size - place))
        found = block.find(b"\n")
        if found >= 0:
            return place + found + 1
        place += len(block)
    return size


def _parts(content: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """Whole lines of about `size` bytes together, with their place."""
    place = 0
    while place < len(content):
        stop = content.find(b"\n", place + size - 1) + 1 or len(content)
        yield place, content[place:stop]
        place = stop


def read(documents: DataFrame, root: str, size: int = SEGMENT, span: int = RANGE) -> DataFrame:
    """The same rows as cut() for documents whose texts are files below root, named by source_file_path;
    `segment` is its place in the file. Ranges of `span` bytes are dealt over the tasks, each reads its
    own and cuts it into segments, and no task reads a file whole. A document whose file isn't there has no segment; bytes that
    aren't UTF-8 raise. Lines end where a \\n is; a line longer than a segment is one segment."""
    fields = [f for f in documents.select(*DOCUMENT).schema.fields]
    ranges = StructType([*fields, *(StructField(c, LongType()) for c in ("segment", "_end", "_size"))])
    texts = StructType([*fields, StructField("segment", LongType()), StructField("text", StringType())])

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(root)
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                n = store.size(row[DOCUMENT.index("source_file_path")])
                begins = range(0, n or 0, span)
                for k in range(0, len(begins), 10_000):
                    part = [(*row, b, min(b + span, n), n) for b in begins[k : k + 10_000]]
                    yield pd.DataFrame(part, columns=ranges.names)

    def fetched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(root)
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                *document, begin, end, n = row
                path = document[DOCUMENT.index("source_file_path")]
                with store.open(path) as f:
                    first, stop = _line_start(f, begin, n), _line_start(f, end, n)
                    f.seek(first)
                    content = f.read(max(stop - first, 0))
                try:
                    parts = [(*document, first + k, c.decode("utf-8")) for k, c in _parts(content, size)]
                except UnicodeDecodeError as e:
                    raise ValueError(f"{path}: not UTF-8 after byte {first}") from e
                yield pd.DataFrame(parts, columns=texts.names)

    at = documents.select(*DOCUMENT).mapInPandas(listed, ranges)
    at = at.repartition(F.xxhash64("source_file_path", "segment"))
    return at.mapInPandas(fetched, texts).withColumns(_keys())


def _folded(segments: DataFrame) -> DataFrame:
    """Segments with their paragraphs, found by a fold over their own lines. A last paragraph of one letter
    is put after each, whose line and heading tell the number of lines and the heading that holds then."""
    body = F.regexp_replace(unix_lines(F.col("text")), r"\n\z", "")
    at = once(segments.filter(F.col("text").isNotNull()), _body=body)
    at = once(at, _all=paragraphs(F.concat("_body", F.lit("\n\nx")), F.lit(None).cast("string")))
    end = F.element_at("_all", -1)
    n = (F.size("_all") - 1).cast("int")
    at = at.select(*DOCUMENT, *_KEY, "segment", "_body", F.slice("_all", F.lit(1), n).alias("_found"), end.alias("_end"))
    return at.withColumn("_lines", F.col("_end.first") - 2)


def _placed(folded: DataFrame) -> DataFrame:
    """(_a, _b, segment) with what comes from the segments before: lines, characters, chunks, the heading
    that holds (above), whether its first paragraph goes on from the segment before (joined) and its last
    one into the next (goes_on). One small row per segment is sorted; of equal documents one."""
    facts = F.struct(
        "_lines", (F.char_length("_body") + 1).alias("chars"), F.size("_found").alias("n"), F.col("_end.heading").alias("heading"),
        F.coalesce(F.get("_found", F.lit(0))["first"] == 1, F.lit(False)).alias("opens"),
        F.coalesce(F.get("_found", F.size("_found") - 1)["last"] == F.col("_lines"), F.lit(False)).alias("ends"),
    )
    at = folded.groupBy(*_KEY, "segment").agg(F.first(facts).alias("f")).select(*_KEY, "segment", "f.*")
    order = W.partitionBy(*_KEY).orderBy("segment")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    at = at.withColumn("joined", F.col("opens") & F.coalesce(F.lag("ends").over(order), F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return at.select(
        *_KEY, "segment", "joined", "n",
        F.coalesce(F.lead("joined").over(order), F.lit(False)).alias("goes_on"),
        total(F.col("_lines").cast("long")).alias("lines"),
        total(F.col("chars").cast("long")).alias("chars"),
        total(F.col("n") - F.col("joined").cast("int")).alias("chunks"),
        F.last("heading", ignorenulls=True).over(before).alias("above"),
    )


def chunk_segments(segments: DataFrame, gate: bool = True) -> DataFrame:
    """The chunks that a fold over each whole document gives, from segments of cut() or read(), with places
    as longs.

    A segment is folded by itself; a prefix pass over one small row per segment gives the numbers, offsets
    and heading that it starts with. Only paragraphs that reach over a border are put together by a
    shuffle of their own. Equal rows are chunked as often as they stand. Documents of equal metadata and
    different texts are told apart by cut(); files have a path each."""
    folded = _folded(status_gate(segments) if gate else segments)
    i, p = F.col("_i"), F.col("_p")
    pieces = folded.select(*DOCUMENT, *_KEY, "segment", "_body", F.posexplode("_found").alias("_i", "_p")).select(
        *DOCUMENT, *_KEY, "segment", "_i", "_p",
        F.substring("_body", p["begin"] + 1, p["stop"] - p["begin"]).alias("text"),
    )
    at = pieces.join(_placed(folded), [*_KEY, "segment"])
    of_many = (F.col("joined") & (i == 0)) | (F.col("goes_on") & (i == F.col("n") - 1))
    at = at.select(
        *DOCUMENT, *_KEY, "segment", "text", of_many.alias("_of_many"),
        (F.col("chunks") + i + 1 - F.col("joined").cast("int")).cast("int").alias("chunk_index"),
        F.coalesce(p["heading"], F.col("above"), F.col("doc_title")).alias("section_heading"),
        (F.col("lines") + p["first"]).alias("first"), (F.col("lines") + p["last"]).alias("last"),
        (F.col("chars") + p["begin"]).alias("char_start"), (F.col("chars") + p["stop"]).alias("char_end"),
    )
    made = [*DOCUMENT, "chunk_index", "section_heading", "first", "last", "char_start", "char_end", "text"]
    whole = at.filter(~F.col("_of_many")).select(*made)
    put = at.filter("_of_many").groupBy(*DOCUMENT, *_KEY, "chunk_index").agg(
        F.first("section_heading").alias("section_heading"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"),
        F.array_sort(F.collect_set(F.struct("segment", "text"))).alias("_parts"), F.count("*").alias("_n"),
    )
    copies = (F.col("_n") / F.size("_parts")).cast("int")
    put = put.withColumn("text", F.array_join("_parts.text", "\n")).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    at = whole.unionByName(put.select(*made))
    return at.select(
        chunk_id(F.col("doc_id"), F.col("version"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id", "doc_title", "doc_type", "version", "status", "department", "section_heading", "source_file_path", "source_hash",
        "chunk_index", F.format_string("lines %d-%d", "first", "last").alias("line_or_page_span"), "char_start", "char_end", "text",
    )


def chunk_any(documents: DataFrame, gate: bool = True, size: int = SEGMENT) -> DataFrame:
    """chunk_documents(), with documents of more than `size` characters chunked by segments. The rows are
    the same whatever the size."""
    long = F.char_length("raw_text") > size
    by_segments = chunk_segments(cut(documents.filter(long), size), gate)
    places = {c: F.col(c).cast("int") for c in ("char_start", "char_end")}
    return chunk_documents(documents.filter(~long), gate).unionByName(by_segments.withColumns(places))
