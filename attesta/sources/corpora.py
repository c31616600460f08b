"""Corpora of Markdown with YAML sidecars as a data source: read and written by the executors."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .bundles import METADATA, BundleError, sidecar_record
from .store import Store

FORMAT = "controlled_corpus"
#: Sidecars of one partition.
SIDECARS = 256
#: Fields of a sidecar that a normalised corpus has.
WRITTEN = ("doc_id", "doc_title", "doc_type", "version", "status", "effective_date", "department", "source_file_path", "source_hash")
COLUMNS = ("sidecar_path", "parse_problem", "inside", *METADATA, "content")


@dataclass
class Sidecars(InputPartition):
    names: list[str]


class CorpusReader(DataSourceReader):
    """A row per sidecar, with the bytes of the source that it names, wherever below the corpus it lies.
    The driver lists the names of sidecars alone; a task reads its sidecars and fetches their sources.
    No other file is read."""

    def __init__(self, path: str, sidecars: int):
        self.path, self.sidecars = path, sidecars

    def partitions(self) -> list[Sidecars]:
        names = Store(self.path).names("metadata", ".yaml")
        return [Sidecars(names[i : i + self.sidecars]) for i in range(0, len(names), self.sidecars)] or [Sidecars([])]

    def read(self, partition: Sidecars) -> Iterator[tuple]:
        store = Store(self.path)
        for name in partition.names:
            row = sidecar_record(name, store.read(f"metadata/{name}") or b"") | {"content": None}
            path = row["source_file_path"]
            row["inside"] = bool(path) and store.inside(path)
            if row["inside"] and row["parse_problem"] is None:
                row["content"] = store.read(path)
            yield tuple(row[c] for c in COLUMNS)


@dataclass
class Written(WriterCommitMessage):
    documents: int


class CorpusWriter(DataSourceWriter):
    """Documents as Markdown files with YAML sidecars. Tasks write into a folder beside the corpus; the
    driver's one rename shows it. A file gets its name when it is whole, and its name and content follow
    from its row, so that a task that runs again, or twice, leaves the same files. After a failure the
    folder goes, and what stood at the path before stays."""

    def __init__(self, path: str, staging: str, columns: list[str], overwrite: bool):
        self.path, self.staging, self.columns, self.overwrite = path, staging, columns, overwrite
        for folder in ("documents", "metadata", ".part"):  # on the driver, before any task
            os.makedirs(f"{staging}/{folder}")

    def write(self, iterator: Iterator) -> Written:
        import yaml

        n = 0
        for row in iterator:
            r = row.asDict()
            side = {f: r[f] for f in WRITTEN}
            try:
                side["effective_date"] = date.fromisoformat(r["effective_date"])
            except (TypeError, ValueError) as e:
                raise BundleError(f"{r['source_path']}: effective_date must be a date") from e
            self._put(r["source_file_path"], r["raw_text"])
            self._put(sidecar_path(r["source_file_path"]), yaml.safe_dump(side, sort_keys=False))
            n += 1
        return Written(n)

    def _put(self, name: str, text: str) -> None:
        part = f"{self.staging}/.part/{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(part, f"{self.staging}/{name}")

    def commit(self, messages: list) -> None:
        shutil.rmtree(f"{self.staging}/.part", ignore_errors=True)
        if os.path.isdir(self.path) and os.listdir(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise BundleError(f"{self.path} exists and is not empty")
            before = f"{self.staging}.before"
            os.rename(self.path, before)
            os.rename(self.staging, self.path)
            shutil.rmtree(before)
            return
        if os.path.isdir(self.path):
            os.rmdir(self.path)
        os.rename(self.staging, self.path)

    def abort(self, messages: list) -> None:
        gone = f"{self.staging}.gone"
        os.rename(self.staging, gone)  # tasks that still run find no folder any more
        for _ in range(10):
            shutil.rmtree(gone, ignore_errors=True)


def sidecar_path(source_file_path: str) -> str:
    return f"metadata/{source_file_path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.yaml"


class ControlledCorpus(DataSource):
    """spark.read.format("controlled_corpus").load(folder); option sidecars: of one partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kinds = {"inside": "boolean", "content": "binary"}
        return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in COLUMNS)

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options["path"], int(self.options.get("sidecars", SIDECARS)))

    def writer(self, schema, overwrite: bool) -> CorpusWriter:
        store = Store(self.options["path"])
        if not store.local:
            raise BundleError("a corpus of files is written to folders that driver and executors share; use a table for other stores")
        return CorpusWriter(store.root, self.options["staging"], schema.names, overwrite)


def read(spark: SparkSession, corpus_dir: str, sidecars: int = SIDECARS) -> DataFrame:
    """A corpus' sidecars with the content of their sources, for validation.check()."""
    spark.dataSource.register(ControlledCorpus)
    return spark.read.format(FORMAT).option("sidecars", sidecars).load(corpus_dir)


def write(documents: DataFrame, path: str, force: bool = False) -> None:
    """Writes a clean corpus of files. A folder with contents is replaced only with force, and then only
    when the new one is whole. The folder must be shared by driver and executors."""
    spark = documents.sparkSession
    spark.dataSource.register(ControlledCorpus)
    root = Store(path).root
    if not force and os.path.isdir(root) and os.listdir(root):
        raise BundleError(f"{path} exists and is not empty; pass force=True to replace it")
    os.makedirs(os.path.dirname(root), exist_ok=True)
    rows = documents.select(*WRITTEN, "raw_text", "source_path")
    staging = f"{os.path.dirname(root)}/.{os.path.basename(root)}.{uuid.uuid4().hex}"
    rows.write.format(FORMAT).mode("overwrite" if force else "append").option("staging", staging).save(root)
