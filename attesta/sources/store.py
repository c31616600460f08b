"""Folders that driver and executors share, and files in them by path."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir. Where that is unset, in local mode (tests) a
    temporary folder is made and set; a cluster needs it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="attesta-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/attesta-{uuid.uuid4().hex}"


class Store:
    """Files below a root folder, in local folders or stores that pyarrow knows. Works in tasks."""

    def __init__(self, root: str):
        from pyarrow import fs

        scheme, _, rest = root.partition("://")
        if not rest or scheme == "file":
            path = (rest or root).removeprefix("file:")
            self.local, self.fs, self.root = True, fs.LocalFileSystem(), os.path.realpath(path)
        else:
            self.local = False
            self.fs, self.root = fs.FileSystem.from_uri(root)

    def names(self, folder: str, suffix: str = "") -> list[str]:
        """Names of the files of a folder below the root, in order; none if there is no such folder."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(suffix))

    def is_folder(self, folder: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(f"{self.root}/{folder}").type == fs.FileType.Directory

    def resolved(self, path: str) -> str:
        """The place that a path names, relative to the root unless it is absolute: without dots, and
        with links of local folders followed."""
        at = posixpath.normpath(posixpath.join(self.root, path))
        return os.path.realpath(posixpath.join(self.root, path)) if self.local else at

    def inside(self, path: str, below: str = "") -> bool:
        """Whether a path stays below the root, or a folder of it."""
        root = self.resolved(below) if below else self.root
        return self.resolved(path).startswith(root.rstrip("/") + "/")

    def read(self, path: str) -> bytes | None:
        """A file's bytes; None if there is none."""
        from pyarrow import fs

        at = self.resolved(path)
        if "\0" in at or self.fs.get_file_info(at).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(at) as f:
            return f.read()

    def size(self, path: str) -> int | None:
        """A file's bytes counted; None if there is none."""
        from pyarrow import fs

        at = self.resolved(path)
        info = None if "\0" in at else self.fs.get_file_info(at)
        return info.size if info and info.type == fs.FileType.File else None

    def open(self, path: str):
        """A file, to be read from any place."""
        return self.fs.open_input_file(self.resolved(path))

    def write(self, path: str, content: bytes) -> None:
        """Puts a file there, which appears when it is whole and replaces one of that name."""
        at = self.resolved(path)
        folder = posixpath.dirname(at)
        self.fs.create_dir(folder, recursive=True)
        part = f"{folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(content)
        self.fs.move(part, at)

    def folders(self, folder: str = "") -> list[str]:
        """Names of the folders in a folder, in order."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
