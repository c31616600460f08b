"""Paragraph chunks with the spans that they quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADING, LINE_END, chunk_id, has_text, once, unix_lines
from ..vocabulary import RETRIEVABLE

_PARAGRAPH = "struct<first:int,last:int,begin:int,stop:int,heading:string>"
#: Items that a fold gathers before it adds them to the rest.
_PART = 256


def status_gate(documents: DataFrame) -> DataFrame:
    """Documents that may be retrieved. It stands before every statistic of the index."""
    return documents.filter(F.col("status").isin(*RETRIEVABLE))


def line_table(documents: DataFrame) -> DataFrame:
    """(doc_id, line_number, char_start, n_chars, is_heading, is_blank) of each line."""
    text = unix_lines(F.col("raw_text"))
    lines = documents.select(
        "doc_id", F.posexplode(_with_offsets(F.split(text, LINE_END, -1))).alias("i", "line")
    )
    line = F.col("line.text")
    return lines.select(
        "doc_id",
        (F.col("i") + 1).alias("line_number"),
        F.col("line.begin").alias("char_start"),
        F.char_length(line).alias("n_chars"),
        line.rlike(HEADING).alias("is_heading"),
        (~has_text(line)).alias("is_blank"),
    )


def _kept(a: Column, when: Column, item: Column) -> tuple[Column, Column]:
    """The fields `part` and `out` of a fold that adds an item when told to. Items gather in part, which
    goes to out as a whole when it has _PART of them, so that a fold over n lines copies far less than
    n times what it has."""
    full = when & (F.size(a["part"]) >= _PART)
    part = F.when(full, F.array(item)).when(when, F.concat(a["part"], F.array(item))).otherwise(a["part"])
    out = F.when(full, F.concat(a["out"], F.array(a["part"]))).otherwise(a["out"])
    return part.alias("part"), out.alias("out")


def _all_kept(a: Column) -> Column:
    return F.flatten(F.concat(a["out"], F.array(a["part"])))


def _nothing(kind: str) -> tuple[Column, Column]:
    return F.array().cast(f"array<{kind}>").alias("part"), F.array().cast(f"array<array<{kind}>>").alias("out")


def _with_offsets(lines: Column) -> Column:
    """Each line with the place of its first character: one fold over the lines of a row."""
    begins = F.aggregate(
        F.transform(lines, lambda x: F.char_length(x)),
        F.struct(F.lit(0).alias("at"), *_nothing("int")),
        lambda a, n: F.struct((a["at"] + n + 1).cast("int").alias("at"), *_kept(a, F.lit(True), a["at"])),
        _all_kept,
    )
    return F.arrays_zip(begins.alias("begin"), lines.alias("text"))


def paragraphs(text: Column, title: Column) -> Column:
    """Paragraphs of a text: runs of lines that are neither blank nor headings, with their first and
    last line, first character and the one after the last, and the heading above (else the title).
    One fold over the lines of a row, so chunking needs no shuffle."""
    lines = F.transform(
        F.split(text, LINE_END, -1),
        lambda x: F.struct(
            F.char_length(x).alias("size"),
            F.when(x.startswith("#") & x.rlike(HEADING), F.regexp_extract(x, HEADING, 2)).alias("heading"),
            has_text(x).alias("text"),
        ),
    )
    zero = F.struct(
        F.lit(0).alias("at"),
        F.lit(1).alias("line"),
        title.alias("heading"),
        F.lit(0).alias("first"),
        F.lit(0).alias("begin"),
        F.lit(0).alias("stop"),
        *_nothing(_PARAGRAPH),
    )

    def done(a: Column) -> Column:
        return F.struct(
            a["first"].alias("first"), (a["line"] - 1).cast("int").alias("last"),
            a["begin"].alias("begin"), a["stop"].alias("stop"), a["heading"].alias("heading"),
        ).cast(_PARAGRAPH)

    def ended(a: Column) -> Column:
        return F.concat(_all_kept(a), F.when(a["first"] > 0, F.array(done(a))).otherwise(F.array().cast(f"array<{_PARAGRAPH}>")))

    def step(a: Column, x: Column) -> Column:
        inside = x["heading"].isNull() & x["text"]
        return F.struct(
            (a["at"] + x["size"] + 1).cast("int").alias("at"),
            (a["line"] + 1).cast("int").alias("line"),
            F.coalesce(x["heading"], a["heading"]).alias("heading"),
            F.when(~inside, 0).when(a["first"] > 0, a["first"]).otherwise(a["line"]).cast("int").alias("first"),
            F.when(~inside, 0).when(a["first"] > 0, a["begin"]).otherwise(a["at"]).cast("int").alias("begin"),
            F.when(inside, a["at"] + x["size"]).otherwise(0).cast("int").alias("stop"),
            *_kept(a, ~inside & (a["first"] > 0), done(a)),
        )

    return F.aggregate(lines, zero, step, ended)


def chunk_documents(documents: DataFrame, gate: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per paragraph of each retrievable document (of each one, without the gate).

    documents: doc_id, doc_title, doc_type, version, status, department, source_file_path,
    source_hash, raw_text. The text is the span that the offsets name; the heading is beside it.
    Null text: no chunk. keep: further columns of documents that chunks carry."""
    rows = status_gate(documents) if gate else documents
    rows = once(rows, _text=unix_lines(F.col("raw_text")))
    at = rows.select(
        "*", F.posexplode(paragraphs(F.col("_text"), F.col("doc_title"))).alias("_i", "p")
    )
    index = (F.col("_i") + 1).cast("int")
    return at.select(
        *keep,
        chunk_id(F.col("doc_id"), F.col("version"), index).alias("chunk_id"),
        "doc_id",
        "doc_title",
        "doc_type",
        "version",
        "status",
        "department",
        F.col("p.heading").alias("section_heading"),
        "source_file_path",
        "source_hash",
        index.alias("chunk_index"),
        F.format_string("lines %d-%d", "p.first", "p.last").alias("line_or_page_span"),
        F.col("p.begin").alias("char_start"),
        F.col("p.stop").alias("char_end"),
        F.substring(F.col("_text"), F.col("p.begin") + 1, F.col("p.stop") - F.col("p.begin")).alias("text"),
    )
