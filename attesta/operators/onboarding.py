"""Messy bundles mapped into the clean corpus shape, with reasons for all that isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import filename_fields, header_fields, is_blank, normalize_version, once, strip
from ..vocabulary import FIELDS, RETRIEVABLE, STATES, STATUSES

_STRINGS = "array<string>"
_PAIRS = "array<struct<source:string,value:string>>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*pairs)[key] if pairs else F.lit(None).cast("string")


def source_paths(listed: DataFrame, register: DataFrame) -> DataFrame:
    """Distinct source_path of files found and files registered."""
    return listed.select("source_path").union(register.select("source_path")).distinct()


def last_of_path(register: DataFrame) -> DataFrame:
    """Of register rows with one path, the last by position."""
    order = W.partitionBy("source_path").orderBy(F.desc("position"))
    return register.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "position")


def evaluate_sources(sources: DataFrame, mapping: dict) -> DataFrame:
    """One record per source: the fields that could be established, where from, reasons and state.

    sources: source_path, safe (inside the documents folder), raw_text (null: no such file),
    register (struct of the fields and current_version, or null). mapping: status_map,
    doc_type_map, filename_patterns [(expression, fields)], header_fields, required_fields.

    A field's candidates are the register's, the file name's and the header's, in this order.
    Equal ones establish it, different ones conflict."""
    at = once(
        sources,
        _file=filename_fields(F.substring_index("source_path", "/", -1), mapping["filename_patterns"]),
        _head=header_fields(F.col("raw_text"), mapping["header_fields"])
        if mapping["header_fields"]
        else F.create_map().cast("map<string,string>"),
        _no_text=is_blank(F.col("raw_text")),
    )
    reasons: list[Column] = []
    found: dict[str, Column] = {}

    def reason(when: Column, text: Column | str) -> None:
        reasons.append(F.when(when, F.lit(text) if isinstance(text, str) else text))

    for field in FIELDS:
        listed = F.col(f"register.{field}")
        found[f"_c_{field}"] = F.filter(
            F.array(
                F.struct(F.lit("register").alias("source"), F.when(listed != "", strip(listed)).alias("value")),
                F.struct(F.lit("filename").alias("source"), F.col("_file")[field].alias("value")),
                F.struct(F.lit("header").alias("source"), strip(F.col("_head")[field]).alias("value")),
            ).cast(_PAIRS),
            lambda c: c["value"].isNotNull() & (c["value"] != ""),
        )
    at = once(at, **found)
    mapped = {
        "status": lambda v: _lookup(mapping["status_map"], v),
        "doc_type": lambda v: _lookup(mapping["doc_type_map"], v),
        "version": normalize_version,
    }
    kept = {}
    for field in FIELDS:
        to = mapped.get(field, lambda v: v)
        kept[f"_k_{field}"] = F.filter(
            F.transform(
                F.col(f"_c_{field}"), lambda c: F.struct(c["source"].alias("source"), to(c["value"]).alias("value"))
            ),
            lambda c: c["value"].isNotNull(),
        )
    at = once(at, **kept)
    picks = {}
    for field in FIELDS:
        own = F.col(f"_k_{field}")
        one = F.size(F.array_distinct(F.transform(own, lambda c: c["value"]))) == 1
        # equal values: the first source names it, for versions the last
        picks[f"_p_{field}"] = F.when(one, F.element_at(own, -1 if field == "version" else 1))
    at = once(at, **picks)
    for field in FIELDS:
        own, pick = F.col(f"_k_{field}"), F.col(f"_p_{field}")
        if field == "doc_id":
            reason(F.size(own) == 0, "no_establishable_doc_id")
        reason((F.size(own) > 1) & pick.isNull(), f"conflicting_field_sources:{field}")
        if field in mapping["required_fields"]:
            reason(pick.isNull(), f"missing_required_field:{field}")
    for field in set(mapping["required_fields"]) - set(FIELDS):
        reason(F.lit(True), f"missing_required_field:{field}")
    reason(F.col("raw_text").isNull(), "source_file_not_found")
    reason(F.col("_no_text"), "empty_source_text")

    def unmapped(field: str, prefix: str) -> Column:
        table = mapping[f"{field}_map"]
        unknown = F.filter(F.col(f"_c_{field}"), lambda c: _lookup(table, c["value"]).isNull())
        return F.transform(unknown, lambda c: F.concat(F.lit(prefix), c["value"]))

    all_ = F.concat(
        F.filter(F.array(*reasons), lambda r: r.isNotNull()),
        unmapped("status", "unknown_status_value:"),
        unmapped("doc_type", "unsupported_doc_type:"),
    )
    all_ = F.when(F.col("safe"), all_).otherwise(F.array(F.lit("unsafe_source_path")))
    value = lambda f: F.when(F.col("safe"), F.col(f"_p_{f}.value"))
    at = once(at, reasons=F.sort_array(F.array_distinct(all_)), canonical_status=value("status"))
    fields = [value(f).alias(f) for f in FIELDS if f != "status"]
    told = F.filter(
        F.array(
            *(F.struct(F.lit(f).alias("key"), F.when(F.col("safe"), F.col(f"_p_{f}.source")).alias("value")) for f in FIELDS)
        ),
        lambda e: e["value"].isNotNull(),
    )
    state = record_state(F.col("canonical_status"), F.col("reasons"))
    return at.select(
        "source_path",
        state.alias("state"),
        (F.coalesce(F.col("canonical_status").isin(*RETRIEVABLE), F.lit(False)) & (state == "mapped_cleanly")).alias("retrievable"),
        "reasons",
        F.map_from_entries(told).alias("field_sources"),
        "canonical_status",
        *fields,
        F.coalesce(F.col("register.current_version"), F.lit(False)).alias("current_version"),
    )


def record_state(status: Column, reasons: Column) -> Column:
    """rejected before needs_review before the two states that a status gives."""
    fatal = F.array(
        *map(F.lit, ("empty_source_text", "unsafe_source_path", "no_establishable_doc_id", "source_file_not_found"))
    )
    return (
        F.when(F.arrays_overlap(reasons, fatal), "rejected")
        .when(F.size(reasons) > 0, "needs_review")
        .when(status.isin(*RETRIEVABLE), "mapped_cleanly")
        .when(status.isin(*STATUSES), "excluded")
        .otherwise("needs_review")
    )


def review_duplicates(records: DataFrame) -> DataFrame:
    """Records whose id has several retrievable ones need review unless just one is flagged current;
    that overwrites any state."""
    gate = F.coalesce(F.col("canonical_status").isin(*RETRIEVABLE), F.lit(False))
    # ids are counted before they meet the records; records without one meet none
    several = (
        records.filter(F.col("doc_id").isNotNull() & gate).groupBy("doc_id")
        .agg(F.count("*").alias("_n"), F.count_if("current_version").alias("_current"))
        .filter("_n > 1 and _current <> 1").select("doc_id", F.lit(True).alias("_several"))
    )
    records = records.join(several, "doc_id", "left").select(*(F.col(f"`{c}`") for c in records.columns), "_several")
    twice = gate & F.coalesce("_several", F.lit(False))
    at = records.withColumn("_twice", twice)
    return at.withColumns(
        {
            "state": F.when(F.col("_twice"), "needs_review").otherwise(F.col("state")),
            "retrievable": F.col("retrievable") & ~F.col("_twice"),
            "reasons": F.when(
                F.col("_twice"), F.sort_array(F.array_union("reasons", F.array(F.lit("duplicate_current_version"))))
            ).otherwise(F.col("reasons")),
        }
    ).drop("_twice", "_several")


def should_emit(state: Column) -> Column:
    return state.isin("mapped_cleanly", "excluded")


def state_counts(records: DataFrame) -> DataFrame:
    """(state, n) of all four states, zeros too."""
    row = records.agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))
    return row.unpivot([], list(STATES), "state", "n")


def field_coverage(records: DataFrame) -> DataFrame:
    """(field, established, missing) of the seven fields."""
    name = lambda f: "canonical_status" if f == "status" else f
    row = records.agg(*(F.count(name(f)).alias(f) for f in FIELDS), F.count("*").alias("_n"))
    long = row.unpivot(["_n"], list(FIELDS), "field", "established")
    return long.select("field", "established", (F.col("_n") - F.col("established")).alias("missing"))


def status_counts(records: DataFrame) -> DataFrame:
    return records.filter("canonical_status is not null").groupBy("canonical_status").agg(F.count("*").alias("n"))


def unknown_statuses(records: DataFrame) -> DataFrame:
    """Distinct status values that the map doesn't have."""
    prefix = "unknown_status_value:"
    return (
        records.select(F.explode("reasons").alias("r")).filter(F.col("r").startswith(prefix))
        .select(F.substring("r", len(prefix) + 1, 2**30).alias("value")).distinct()
    )
