"""Scalar functions, as columns. None of them is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import STOPWORDS

#: What Python's \w matches, as far as Java's classes have it (\w alone is ASCII there).
WORD = r"[\p{L}\p{N}_]+"
#: What str.splitlines() splits on, once \r\n and \r are \n.
LINE_END = "[\\n\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: What str.strip() takes away.
BLANK = r"[\s\x0b\x1c-\x1f\x85   -     　]"
NOT_BLANK = BLANK.replace("[", "[^", 1)
HEADING = rf"\A(#{{1,6}}){BLANK}+(.*[^\s\x0b\x1c-\x1f\x85   -     　]){BLANK}*\z"


def tokenize(text: Column) -> Column:
    """Lower-case words, in order, repeats kept. Null text gives no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def content_terms(text: Column) -> Column:
    """Distinct words of more than one character that aren't stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(
        F.filter(tokenize(text), lambda w: (F.char_length(w) > 1) & ~F.array_contains(stop, w))
    )


def coverage(terms: Column, tokens: Column) -> Column:
    """Share of a question's terms that stand in a text; no terms: 0."""
    return F.when(
        F.size(terms) > 0, F.size(F.array_intersect(terms, tokens)) / F.size(terms).cast("double")
    ).otherwise(F.lit(0.0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row. Projections may be merged, and what is used
    often then computed as often; a generator stands between them, without a shuffle."""
    row = F.struct(*(c.alias(n) for n, c in columns.items()))
    at = df.select("*", F.explode(F.array(row)).alias("_once"))
    return at.select(*df.columns, *(F.col(f"_once.{n}").alias(n) for n in columns))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def has_text(text: Column) -> Column:
    """Whether a line has anything but blanks; stops at the first such character."""
    return text.rlike(NOT_BLANK)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(has_text(text), F.lit(False))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def source_hash(content: Column) -> Column:
    """Hash of the raw bytes, before line ends are unified."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def safe_version(version: Column) -> Column:
    return F.trim(F.regexp_replace(version, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def chunk_id(doc_id: Column, version: Column, index: Column) -> Column:
    return F.format_string("%s_v%s_chunk_%03d", doc_id, safe_version(version), index)


def normalize_version(version: Column) -> Column:
    """Without a leading rev-, or a v before a digit."""
    v = strip(version)
    return (
        F.when(F.lower(v).startswith("rev-"), F.substring(v, 5, 2**30))
        .when(v.rlike(r"\A[vV]\p{Nd}"), F.substring(v, 2, 2**30))
        .otherwise(v)
    )


def resolved_path(path: Column) -> Column:
    """A relative path without '.' and '..'; null for one that is absolute, climbs above where it
    starts, or names the start itself."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(state, part):
        up = part == ".."
        at = F.when(up, F.slice(state["at"], 1, F.greatest(F.size(state["at"]) - 1, F.lit(0)))).otherwise(
            F.concat(state["at"], F.array(part))
        )
        return F.struct(at.alias("at"), (state["ok"] & ~(up & (F.size(state["at"]) == 0))).alias("ok"))

    ends = lambda s: F.when(s["ok"] & (F.size(s["at"]) > 0), F.array_join(s["at"], "/"))
    return F.when(~path.startswith("/"), F.aggregate(parts, start, step, ends))


def fraction(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("n/a")).otherwise(F.format_string("%d/%d", part, whole))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is null or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def header_fields(text: Column, names: dict[str, str]) -> Column:
    """map<field, value> of the leading `Key: value` lines. Reading stops at a blank line, a heading
    or a line without a colon; keys are matched without case; the last of a key wins."""
    fields = F.create_map(*(F.lit(x) for f, n in names.items() for x in (n.lower(), f)))
    # only what stands before the first blank line or heading is looked at
    top = F.split(unix_lines(F.coalesce(text, F.lit(""))), rf"\A(?=#)|\n(?=#)|\n(?={BLANK}*+\n)", 2)[0]
    stop = lambda x: is_blank(x) | x.startswith("#") | ~x.contains(":")

    def head(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, stop), F.lit(True))
        count = lambda p: F.when(p > 0, p - 1).otherwise(F.size(lines)).cast("int")
        return let(first, lambda p: F.slice(lines, F.lit(1), count(p)))

    def pair(line: Column) -> Column:
        return F.struct(
            fields[F.lower(strip(F.substring_index(line, ":", 1)))].alias("key"),
            strip(F.substring(line, F.instr(line, ":") + 1, F.lit(2**30))).alias("value"),
        )

    def last(pairs: Column) -> Column:
        """Of pairs with one key, the last."""
        keys = F.transform(pairs, lambda p: p["key"])
        again = lambda p, i: F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"])
        return F.filter(pairs, lambda p, i: ~again(p, i))

    known = lambda lines: F.filter(F.transform(lines, pair), lambda p: p["key"].isNotNull())
    return let(F.split(top, LINE_END, -1), lambda x: let(known(head(x)), lambda p: F.map_from_entries(last(p))))


def filename_fields(name: Column, patterns: list[tuple[str, list[str]]]) -> Column:
    """map<field, value> of the first pattern that matches. A pattern is a Java expression and the
    fields of its groups, in order; groups that didn't take part are left out."""
    found = F.lit(None).cast("map<string,string>")
    for pattern, fields in reversed(patterns):
        entries = F.array(
            *(
                F.struct(
                    F.lit(f).alias("key"),
                    (normalize_version if f == "version" else lambda c: c)(
                        F.regexp_extract(name, pattern, i + 1)
                    ).alias("value"),
                )
                for i, f in enumerate(fields)
            )
        )
        entries = F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))
        found = F.when(name.rlike(pattern), entries).otherwise(found)
    return F.coalesce(found, F.create_map().cast("map<string,string>"))
