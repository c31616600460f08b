"""Folders of Markdown with YAML, and JSON fixtures, as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import resolved_path, source_hash
from ..vocabulary import FIELDS, NO_METADATA_DIR, NO_SIDECARS, OUTCOMES, STATUSES
from .store import Store

METADATA = (*FIELDS, "review_due_date", "source_file_path", "source_hash")
_SIDECAR = "sidecar_path string, parse_problem string, inside boolean, " + ", ".join(f"{f} string" for f in METADATA)


class BundleError(Exception):
    """An input that can't be read or has the wrong shape."""


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files of one folder; path is the name in it."""
    at = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    at = at.select(F.substring_index("path", "/", -1).alias("path"), "content")
    # scans leave out files without bytes
    empty = [(f.getPath().getName(), bytearray()) for f in _listed(spark, folder, pattern) if f.isFile() and not f.getLen()]
    return at.unionByName(spark.createDataFrame(empty, "path string, content binary")) if empty else at


def _listed(spark: SparkSession, folder: str, pattern: str) -> list:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = hadoop(f"{folder}/{pattern}")
    return list(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or [])


def parse_yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def sidecar_record(name: str, content: bytes) -> dict:
    """One sidecar's fields as text, or what is wrong with it. Unknown keys are wrong."""
    out: dict = dict.fromkeys(("parse_problem", *METADATA)) | {"sidecar_path": f"metadata/{name}", "inside": False}
    try:
        raw = parse_yaml(content.decode("utf-8"))
    except Exception as e:  # whatever the parser raises is this sidecar's issue
        return out | {"parse_problem": f"invalid YAML: {type(e).__name__}"}
    raw = {} if raw is None else raw
    if not isinstance(raw, dict):
        return out | {"parse_problem": "metadata must be a mapping"}
    unknown = sorted(str(k) for k in raw if k not in METADATA)
    missing = [f for f in METADATA if raw.get(f) is None and f != "review_due_date"]
    if unknown or missing:
        told = [f"{f}: field required" for f in missing] + [f"{f}: unknown field" for f in unknown]
        out["parse_problem"] = "; ".join(told)
    for f in METADATA:
        value = raw.get(f)
        out[f] = None if value is None else str(value)
        if isinstance(value, str) and f in ("doc_id", "doc_title", "version", "department"):
            out[f] = value.strip()
    out["inside"] = is_inside(out["source_file_path"] or "", "")
    return out


def is_inside(path: str, root: str) -> bool:
    """Whether a relative path stays below root without looking at the store."""
    if not path or path.startswith("/"):
        return False
    parts: list[str] = []
    for part in PurePosixPath(path).parts:
        if part == "..":
            if not parts:
                return False
            parts.pop()
        elif part != ".":
            parts.append(part)
    below = PurePosixPath(root).parts if root else ()
    return tuple(parts[: len(below)]) == below and len(parts) > len(below)


def read_sidecars(spark: SparkSession, corpus_dir: str) -> DataFrame:
    """metadata/*.yaml, not below it. Sidecars are parsed where they are read. A corpus without any
    has no rows."""
    if not _listed(spark, f"{corpus_dir}/metadata", "*.yaml"):
        return spark.createDataFrame([], _SIDECAR)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["sidecar_path", "parse_problem", "inside", *METADATA]
        for frame in frames:
            rows = [sidecar_record(p, c) for p, c in zip(frame["path"], frame["content"])]
            yield pd.DataFrame(rows, columns=columns)

    return _files(spark, f"{corpus_dir}/metadata", "*.yaml").mapInPandas(parse, _SIDECAR)


def known(folder: str) -> bool:
    """Whether tasks can open the files of a folder themselves; Spark's readers reach more stores."""
    try:
        Store(folder)
    except Exception:  # whatever a store's client raises where it is unknown or absent
        return False
    return True


def read_sources(spark: SparkSession, corpus_dir: str, below: str = "documents") -> DataFrame:
    """(path, content) of a corpus' source files; path is relative to the corpus."""
    if not _listed(spark, f"{corpus_dir}/{below}", "*"):
        return spark.createDataFrame([], "path string, content binary")
    return _files(spark, f"{corpus_dir}/{below}", "*").withColumn("path", F.concat(F.lit(f"{below}/"), "path"))


def read_corpus(spark: SparkSession, corpus_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, issues) of a corpus folder. A corpus without metadata is an issue of its folder. In
    stores that only Spark's readers reach, sources are those of the folder documents/ itself."""
    from ..operators.validation import check
    from . import corpora

    if known(corpus_dir):
        documents, issues = check(corpora.read(spark, corpus_dir))
        store = Store(corpus_dir)
        names, there = store.names("metadata", ".yaml"), store.is_folder("metadata")
    else:
        documents, issues = check(read_sidecars(spark, corpus_dir), read_sources(spark, corpus_dir))
        names, there = _listed(spark, f"{corpus_dir}/metadata", "*.yaml"), bool(_listed(spark, corpus_dir, "metadata"))
    if not names:
        told = NO_SIDECARS if there else NO_METADATA_DIR
        none = spark.createDataFrame([(f"{corpus_dir}/metadata", told)], "path string, message string")
        issues = issues.unionByName(none)
    return documents, issues


def load_corpus(spark: SparkSession, corpus_dir: str) -> DataFrame:
    """Documents of a corpus without any issue; otherwise CorpusInvalid."""
    from ..operators.validation import require_valid

    return require_valid(*read_corpus(spark, corpus_dir))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text, through Spark's readers."""
    folder, _, name = path.rpartition("/")
    content = [f for f in _listed(spark, folder or ".", name) if f.isFile()]
    if len(content) != 1:
        raise BundleError(f"{path}: one file is needed")
    try:
        return bytes(_files(spark, folder or ".", name).first()["content"]).decode("utf-8")
    except UnicodeDecodeError as e:
        raise BundleError(f"{path}: must be UTF-8") from e


def file_hash(spark: SparkSession, path: str) -> str:
    """The hash of a file's bytes, as sidecars state it."""
    folder, _, name = path.rpartition("/")
    return _files(spark, folder or ".", name).select(source_hash(F.col("content"))).first()[0]


def read_mapping(spark: SparkSession, path: str) -> dict:
    """A mapping file: maps, file name patterns (checked, their named groups numbered), header
    names, required fields. Unknown keys and bad expressions raise."""
    raw = parse_yaml(read_text(spark, path)) or {}
    known = {"schema_version", "client_label", "status_map", "doc_type_map", "filename_patterns", "header_fields", "required_fields"}
    if not isinstance(raw, dict) or set(raw) - known:
        raise BundleError(f"{path}: unknown or missing mapping keys")
    patterns = []
    for p in raw.get("filename_patterns") or []:
        try:
            fields = list(re.compile(p["pattern"]).groupindex)
        except (re.error, KeyError, TypeError) as e:
            raise BundleError(f"{path}: invalid filename pattern: {e}") from e
        patterns.append((re.sub(r"\(\?P<\w+>", "(", p["pattern"]), fields))
    return {
        "status_map": dict(raw.get("status_map") or {}),
        "doc_type_map": dict(raw.get("doc_type_map") or {}),
        "filename_patterns": patterns,
        "header_fields": dict(raw.get("header_fields") or {}),
        "required_fields": list(raw.get("required_fields") or FIELDS),
    }


_REGISTER = "position long, source_path string, " + ", ".join(f"{f} string" for f in FIELDS) + ", current_version boolean"


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """A source register: a list of records, or a mapping with one under `records`."""
    raw = parse_yaml(read_text(spark, path)) or {}
    records = raw.get("records", []) if isinstance(raw, dict) else raw
    if not isinstance(records, list):
        raise BundleError(f"{path}: source register must contain a list of records")
    rows = []
    for i, r in enumerate(records):
        unknown = set(r) - {"source_path", "current_version", *FIELDS}
        if unknown or not r.get("source_path"):
            raise BundleError(f"{path}: record {i}: unknown fields or no source_path")
        text = [None if r.get(f) is None else str(r[f]) for f in FIELDS]
        rows.append((i, r["source_path"], *text, r.get("current_version")))
    return spark.createDataFrame(rows, _REGISTER)


MAPPING, REGISTER = "metadata-map.yaml", "incoming/source-register.yaml"


def _below(path: Column, root: str) -> Column:
    """Whether a relative path stays below root, whatever dots it has."""
    return F.coalesce(resolved_path(path).startswith(f"{root}/"), F.lit(False))


def _fetched(paths: DataFrame, root: str, below: str) -> DataFrame:
    """(source_path, safe, content) of paths(source_path): each is looked up, and read, where its task
    runs. One that leaves the folder, by dots or by a link, isn't safe and isn't read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(root)
        for frame in frames:
            safe = [store.inside(p, below) for p in frame["source_path"]]
            content = [store.read(p) if s else None for p, s in zip(frame["source_path"], safe)]
            yield pd.DataFrame({"source_path": frame["source_path"], "safe": safe, "content": content})

    return paths.mapInPandas(run, "source_path string, safe boolean, content binary")


def read_bundle(
    spark: SparkSession, bundle_dir: str, mapping_path: str | None = None, register_path: str | None = None
) -> tuple[DataFrame, dict]:
    """(sources, mapping) of a messy bundle, ready for evaluate_sources(). A source that isn't UTF-8
    counts as one without text, links that lead out of the bundle are not safe. Registered sources are
    found in any folder below the documents; the others are the Markdown files of that folder itself."""
    from ..operators.onboarding import last_of_path, source_paths

    mapping = read_mapping(spark, mapping_path or f"{bundle_dir}/{MAPPING}")
    register = read_register(spark, register_path or f"{bundle_dir}/{REGISTER}")
    below = "incoming/documents"
    if known(bundle_dir):
        names = [(f"{below}/{n}",) for n in Store(bundle_dir).names(below, ".md")]
        listed = spark.createDataFrame(names, "source_path string")
        files = _fetched(source_paths(listed, register), bundle_dir, below)
    else:
        held = read_sources(spark, bundle_dir, below).withColumnRenamed("path", "source_path")
        listed = held.filter(F.col("source_path").endswith(".md"))
        files = source_paths(listed, register).join(held, "source_path", "left")
        files = files.withColumn("safe", _below(F.col("source_path"), below))
    last = last_of_path(register)
    fields = F.struct(*FIELDS, "current_version").alias("register")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise("")
    return (
        files.join(last.select("source_path", fields), "source_path", "left")
        .select("source_path", "safe", F.when(F.col("content").isNotNull(), text).alias("raw_text"), "register"),
        mapping,
    )


_NEEDED = object()
_CITATIONS = [{"chunk_id": ("text", _NEEDED), "label": ("label", None)}]
_ANSWER = {"answer_text": ("text", _NEEDED), "citations": (_CITATIONS, []), "expected_outcome": (OUTCOMES, _NEEDED)}
_CASES = [{
    "case_id": ("text", _NEEDED), "question": ("text", _NEEDED), "expected_outcome": (OUTCOMES, _NEEDED), "top_k": ("count", 3),
    "expected_source_doc_ids": ("texts", []), "expected_chunk_ids": ("texts", []), "forbidden_doc_ids": ("texts", []),
    "expect_no_hits": ("flag", False), "answer_fixture": (_ANSWER, None),
    "expected_citation_resolves_to_retrieved_chunk": ("flag", None), "expected_citation_issue_codes": ("texts", []),
}]
_SUITE = {"suite_name": ("text", _NEEDED), "cases": (_CASES, _NEEDED)}
#: Payloads of retrieval may hold more than is needed.
_RETRIEVED = {
    "...": (), "query": ("words", None), "hits": ([{"...": (), "chunk_id": ("text", _NEEDED), "status": (STATUSES, _NEEDED)}], []),
}
_KINDS = {
    "text": lambda v: isinstance(v, str) and v != "",
    "label": lambda v: v is None or (isinstance(v, str) and v != ""),
    "words": lambda v: v is None or isinstance(v, str),
    "count": lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 1,
    "flag": lambda v: isinstance(v, bool),
    "texts": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v),
}


def conform(value, kind, at: str, wrong: list[str], default=_NEEDED):
    """A value by its kind: a name of _KINDS, a tuple of allowed values, a dict of fields (unknown ones
    are wrong unless it has '...'), or a list of such. What is wrong is added to `wrong`."""
    if value is None and default is None:
        return None
    if isinstance(kind, list):
        if not isinstance(value, list):
            wrong.append(f"{at}: must be a list")
            return []
        return [conform(v, kind[0], f"{at}.{i}", wrong) for i, v in enumerate(value)]
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            wrong.append(f"{at}: must be an object")
            return {}
        if "..." not in kind:
            wrong += [f"{at}.{k}: unknown field" for k in value if k not in kind]
        out = {}
        for name, (own, given) in ((k, v) for k, v in kind.items() if k != "..."):
            if name in value:
                out[name] = conform(value[name], own, f"{at}.{name}", wrong, given)
            elif given is _NEEDED:
                wrong.append(f"{at}.{name}: field required")
            else:
                out[name] = given
        return out
    if not (value in kind if isinstance(kind, tuple) else _KINDS[kind](value)):
        wrong.append(f"{at}: {value!r} is not allowed")
    return value


def read_json(spark: SparkSession, path: str, spec: dict) -> dict:
    """A JSON file of a known shape. A broken file, or one of another shape, raises."""
    try:
        raw = json.loads(read_text(spark, path))
    except json.JSONDecodeError as e:
        raise BundleError(f"{path}: invalid JSON: {e}") from e
    wrong: list[str] = []
    out = conform(raw, spec, "", wrong)
    if wrong:
        raise BundleError(f"{path}: " + "; ".join(w.lstrip(".") for w in wrong))
    return out


_CITATION = "array<struct<chunk_id:string,label:string>>"
_CASE_COLUMNS = f"""case_id string, question string, expected_outcome string, top_k int,
expected_source_doc_ids array<string>, expected_chunk_ids array<string>, forbidden_doc_ids array<string>,
expect_no_hits boolean, fixture_outcome string, fixture_citations {_CITATION}, expected_resolves boolean,
expected_issue_codes array<string>"""


def load_suite(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(name, cases) of an evaluation suite, with defaults, ready for run_cases(). A suite without
    cases, of another shape, or whose cases contradict themselves, raises."""
    suite = read_json(spark, path, _SUITE)
    rows, bad = [], []
    for case in suite["cases"]:
        fixture = case.pop("answer_fixture") or {}
        resolves = case.pop("expected_citation_resolves_to_retrieved_chunk")
        codes = case.pop("expected_citation_issue_codes")
        if fixture:
            wrong = resolves is None or fixture["expected_outcome"] != case["expected_outcome"]
        else:
            wrong = resolves is not None or bool(codes)
        if wrong:
            bad.append(case["case_id"])
        cited = [(c["chunk_id"], c["label"]) for c in fixture.get("citations", [])]
        rows.append((*case.values(), fixture.get("expected_outcome"), cited, resolves, codes))
    if bad or not rows:
        raise BundleError(f"{path}: no cases, or cases that contradict themselves: {bad}")
    return suite["suite_name"], spark.createDataFrame(rows, _CASE_COLUMNS)


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """The cases of load_suite()."""
    return load_suite(spark, path)[1]


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """A retrieval payload: query, retrieved. Keys that aren't needed may be there."""
    got = read_json(spark, path, _RETRIEVED)
    hits = [(h["chunk_id"], h["status"]) for h in got["hits"]]
    return spark.createDataFrame([(got["query"], hits)], "query string, retrieved array<struct<chunk_id:string,status:string>>")


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    """An answer fixture: answer_text, citations, outcome."""
    got = read_json(spark, path, _ANSWER)
    cited = [(c["chunk_id"], c["label"]) for c in got["citations"]]
    row = (got["answer_text"], cited, got["expected_outcome"])
    return spark.createDataFrame([row], f"answer_text string, citations {_CITATION}, outcome string")


def read_exported_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks and held-out chunks of an export, one row each."""
    fields = (
        "chunk_id:string,doc_id:string,doc_title:string,doc_type:string,version:string,status:string,"
        "department:string,section_heading:string,source_file_path:string,source_hash:string,"
        "chunk_index:int,line_or_page_span:string,char_start:int,char_end:int,text:string"
    )
    one = f"array<struct<{fields}>>"
    raw = spark.read.schema(f"chunks {one}, held_out_chunks {one}").option("multiLine", True).json(path)
    part = lambda c, held: raw.select(F.explode(c).alias("c")).select("c.*", F.lit(held).alias("held_out"))
    return part("chunks", False).unionByName(part("held_out_chunks", True))


def read_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, tier string, relevant_doc string, query string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scrape_questions(page: DataFrame, column: str = "html") -> DataFrame:
    """Questions that a demo page offers in data-q attributes, references decoded."""
    found = F.regexp_extract_all(column, F.lit(r'data-q="([^"]+)"'), F.lit(1))
    question = F.col("q")
    # The references that such attributes use.
    for ref, plain in (("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        question = F.replace(question, F.lit(ref), F.lit(plain))
    return page.select(F.explode(found).alias("q")).select(question.alias("question"))


def first_of_each(questions: DataFrame) -> DataFrame:
    """Questions without repeats; the first by position stays."""
    return questions.groupBy("question").agg(F.min("position").alias("position"))


def corpus_registry(spark: SparkSession, spec: str) -> dict[str, str]:
    """'name=path,name=path' as an allowlist. Empty and repeated names raise."""
    out: dict[str, str] = {}
    for item in filter(None, (x.strip() for x in spec.split(","))):
        name, mark, path = (x.strip() for x in item.partition("="))
        if not mark or not name or not path or name in out:
            raise BundleError(f"corpus entry needs name=path, once each: {item}")
        out[name] = path
    return out


def dump(record: dict, ordered: bool = True) -> str:
    """JSON text with sorted keys, or with keys as they stand."""
    return json.dumps(record, indent=2, sort_keys=ordered) + "\n"
