"""Corpora read and written by tasks: sources anywhere below a corpus, commits as a whole."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from attesta.functions.text import resolved_path
from attesta.plans import service
from attesta.sources import bundles, corpora, sinks


def sidecar(root, name, path, text, doc=None, hash_=None, **more):
    os.makedirs(f"{root}/metadata", exist_ok=True)
    fields = {
        "doc_id": doc or name, "doc_title": f"Title {name}", "doc_type": "SOP", "version": "1.0", "status": "Approved", "department": "QA",
        "effective_date": "2024-01-31", "source_file_path": path, "source_hash": hash_ or "sha256:" + hashlib.sha256(text.encode()).hexdigest(), **more,
    }
    with open(f"{root}/metadata/{name}.yaml", "w") as f:
        f.writelines(f"{k}: '{v}'\n" for k, v in fields.items())


def put(root, path, text):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "w", newline="") as f:
        f.write(text)


PLACES = {
    "flat": ("documents/a.md", "documents/a.md"), "nested": ("documents/sub/b.md", "documents/sub/b.md"),
    "annex": ("annex/c.md", "annex/c.md"), "dots": ("./documents/d.md", "documents/d.md"),
    "up": ("documents/x/../e.md", "documents/e.md"), "top": ("f.md", "f.md"),
}


def good(root):
    for name, (path, at) in PLACES.items():
        put(root, at, f"# H\n\ntext of {name}\n")
        sidecar(root, name, path, f"# H\n\ntext of {name}\n")
    return str(root)


@pytest.mark.parametrize("size", [1, 4, 256])
def test_sources_anywhere_below_the_corpus(spark, tmp_path, size):
    root = good(tmp_path / "c")
    put(tmp_path, "c/documents/unused.md", "\xff not read")
    os.chmod(f"{root}/documents/unused.md", 0)
    docs = bundles.load_corpus(spark, root)
    assert {r["doc_id"]: r["raw_text"] for r in docs.collect()} == {n: f"# H\n\ntext of {n}\n" for n in PLACES}
    rows = corpora.read(spark, root, size)
    assert rows.rdd.getNumPartitions() == -(-len(PLACES) // size)


def test_absolute_paths_links_and_faults(spark, tmp_path):
    root, out = tmp_path / "c", tmp_path / "other"
    put(out, "secret.md", "secret")
    put(root, "documents/in.md", "inside")
    put(root, "documents/empty.md", "")
    put(root, "documents/changed.md", "changed")
    os.makedirs(root / "documents/folder")
    os.symlink(out / "secret.md", root / "documents/link.md")
    os.symlink(root / "documents/in.md", root / "documents/own.md")
    sidecar(root, "absolute", f"{root}/documents/in.md", "inside")
    sidecar(root, "own", "documents/own.md", "inside")
    sidecar(root, "link", "documents/link.md", "secret")
    sidecar(root, "climbs", "../other/secret.md", "secret")
    sidecar(root, "folder", "documents/folder", "x")
    sidecar(root, "gone", "documents/gone.md", "x")
    sidecar(root, "empty", "documents/empty.md", "")
    sidecar(root, "changed", "documents/changed.md", "as it was")
    docs, issues = bundles.read_corpus(spark, str(root))
    assert sorted(r["doc_id"] for r in docs.collect()) == ["absolute", "own"]
    told = {r["path"]: r["message"] for r in issues.collect()}
    outside = "source_file_path must stay inside the corpus directory"
    assert told == {
        "metadata/link.yaml": outside, "metadata/climbs.yaml": outside, "metadata/folder.yaml": "source file not found: documents/folder",
        "metadata/gone.yaml": "source file not found: documents/gone.md", "documents/empty.md": "source file must not be empty",
        "metadata/changed.yaml": "source_hash does not match source file content",
    }


def test_paths_resolve_as_in_folders(spark, tmp_path):
    paths = ["a/b", "./a", "a/./b//c", "a/../b", "a/b/../../c", "../a", "a/../../b", "/a", "", ".", "a/..", "a/...", "..a/b"]
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "p string")
    got = {r["p"]: r["r"] for r in df.select("p", resolved_path(F.col("p")).alias("r")).collect()}
    root = str(tmp_path.resolve())
    for p in paths:
        at = os.path.normpath(os.path.join(root, p))
        assert got[p] == (at[len(root) + 1 :] if at.startswith(root + "/") and not p.startswith("/") else None), p
    assert got[None] is None


def test_registered_sources_in_folders_below(spark, tmp_path):
    put(tmp_path, "metadata-map.yaml", "required_fields: [doc_id]\n")
    put(tmp_path, "incoming/documents/plain.md", "plain")
    put(tmp_path, "incoming/documents/sub/deep.md", "deep")
    put(tmp_path, "incoming/secret.md", "secret")
    os.symlink(tmp_path / "incoming/secret.md", tmp_path / "incoming/documents/led.md")
    paths = ["incoming/documents/sub/deep.md", "incoming/documents/sub/gone.md", "incoming/documents/../secret.md", "incoming/documents/led.md"]
    put(tmp_path, "incoming/source-register.yaml", "records:\n" + "".join(f"- source_path: {p}\n" for p in paths))
    sources, _ = bundles.read_bundle(spark, str(tmp_path))
    got = {r["source_path"].removeprefix("incoming/"): (r["safe"], r["raw_text"]) for r in sources.collect()}
    assert got == {
        "documents/plain.md": (True, "plain"), "documents/sub/deep.md": (True, "deep"), "documents/sub/gone.md": (True, None),
        "documents/../secret.md": (False, None), "documents/led.md": (False, None),
    }


def clean(spark, n, bad=None):
    i = F.col("id").cast("string")
    text = F.concat(F.lit("# H\r\n\ntext é "), i)
    date = F.when(F.col("id") == (-1 if bad is None else bad), "soon").otherwise("2024-01-31")
    return spark.range(n).repartition(6).select(
        F.concat(F.lit("D"), i).alias("doc_id"), F.lit("T: 'x'").alias("doc_title"), F.lit("SOP").alias("doc_type"), F.lit("1.0").alias("version"),
        F.lit("Approved").alias("status"), date.alias("effective_date"), F.lit("QA").alias("department"),
        F.concat(F.lit("documents/"), i, F.lit(".md")).alias("source_file_path"),
        F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256)).alias("source_hash"), text.alias("raw_text"),
        F.concat(F.lit("in/"), i, F.lit(".md")).alias("source_path"),
    )


def test_written_by_tasks_and_read_again(spark, tmp_path):
    at = str(tmp_path / "new/corpus")
    corpora.write(clean(spark, 300), at)
    docs = bundles.load_corpus(spark, at)
    got = {(r["doc_id"], r["raw_text"], r["doc_title"]) for r in docs.collect()}
    assert got == {(f"D{i}", f"# H\r\n\ntext é {i}", "T: 'x'") for i in range(300)}
    assert sorted(os.listdir(at)) == ["documents", "metadata"] and os.listdir(tmp_path / "new") == ["corpus"]
    paths = {r[0]: r[1] for r in sinks.metadata_paths(clean(spark, 3)).collect()}
    assert paths == {f"in/{i}.md": f"metadata/{i}.yaml" for i in range(3)}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "corpus")
    with pytest.raises(Exception, match="effective_date must be a date"):
        corpora.write(clean(spark, 100, bad=57), at)
    assert os.listdir(tmp_path) == []


def test_what_stood_before_stays_until_the_new_one_is_whole(spark, tmp_path):
    at = str(tmp_path / "corpus")
    corpora.write(clean(spark, 3), at)
    with pytest.raises(bundles.BundleError, match="not empty"):
        corpora.write(clean(spark, 5), at)
    with pytest.raises(Exception, match="effective_date must be a date"):
        corpora.write(clean(spark, 9, bad=4), at, force=True)
    assert len(os.listdir(f"{at}/documents")) == 3 and os.listdir(tmp_path) == ["corpus"]
    corpora.write(clean(spark, 5), at, force=True)
    assert len(os.listdir(f"{at}/documents")) == 5 == len(os.listdir(f"{at}/metadata")) and os.listdir(tmp_path) == ["corpus"]


def test_a_task_that_runs_again_leaves_the_same_files(tmp_path):
    """Two attempts of one task, the first of which ends half way."""
    from pyspark.sql import Row

    rows = [Row(**{f: f"{f}{i}" for f in corpora.WRITTEN} | {"effective_date": "2024-01-31", "source_file_path": f"documents/{i}.md", "raw_text": f"t{i}", "source_path": f"s{i}"}) for i in range(4)]
    w = corpora.CorpusWriter(str(tmp_path / "c"), str(tmp_path / ".c.x"), [], False)

    def half():
        yield from rows[:2]
        raise OSError("lost")

    with pytest.raises(OSError):
        w.write(half())
    assert w.write(iter(rows)).documents == 4
    assert not os.path.exists(w.path)
    w.commit([])
    assert sorted(os.listdir(f"{w.path}/documents")) == [f"{i}.md" for i in range(4)] and sorted(os.listdir(w.path)) == ["documents", "metadata"]


def test_empty_corpus(spark, tmp_path):
    at = str(tmp_path / "corpus")
    corpora.write(clean(spark, 0), at)
    _, issues = bundles.read_corpus(spark, at)
    assert [r["message"] for r in issues.collect()] and sorted(os.listdir(at)) == ["documents", "metadata"]


def test_service_reads_nested_sources(spark, tmp_path):
    root = good(tmp_path / "c")
    assert service.Service(spark, {"c": root}).validate_corpus()["valid"]
