"""Whole files out of rows ``path, content``, as a Spark data source with commit and abort.

Tasks write into a folder of their own below ``<root>/_pending``; when all have ended, the driver moves the files to
their places. If the job fails, the folder goes and nothing has appeared. A task that runs again writes into another
folder, and only that of the attempt which Spark commits is moved. ``root`` is a folder that executors and driver
reach, a path or the address of a store; paths are relative to it. Files that are there already are replaced.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "whole_files"
PENDING = "_pending"
MOVES = 16  # files that the driver moves at a time


def _store(root: str):
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root)


def safe_path(path: str) -> str:
    """A path below the root; anything that leaves it, or the folder of pending files, is refused."""
    clean = posixpath.normpath(path)
    if not path or clean.startswith(("/", "..")) or clean.split("/")[0] in (".", PENDING):
        raise ValueError(f"not a path below the root: {path!r}")
    return clean


@dataclass
class Written(WriterCommitMessage):
    folder: str
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator) -> Written:
        store, base = _store(self.root)
        folder, paths = f"{base}/{PENDING}/{self.job}/{uuid.uuid4().hex}", {}
        for r in iterator:
            if r["path"] is None or r["content"] is None:
                continue
            path = safe_path(r["path"])
            store.create_dir(posixpath.dirname(f"{folder}/{path}"), recursive=True)
            with store.open_output_stream(f"{folder}/{path}") as f:
                f.write(bytes(r["content"]))
            paths[path] = None  # a path that comes twice in a task is one file, the last
        return Written(folder, list(paths))

    def commit(self, messages: list) -> None:
        store, base = _store(self.root)

        def move(item: tuple[str, str]) -> None:
            folder, path = item
            store.create_dir(posixpath.dirname(f"{base}/{path}"), recursive=True)
            store.move(f"{folder}/{path}", f"{base}/{path}")

        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(move, [(m.folder, p) for m in messages if m is not None for p in m.paths]))
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, base = _store(self.root)
        folder = f"{base}/{PENDING}/{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
        rest = fs.FileSelector(f"{base}/{PENDING}", allow_not_found=True)
        if store.get_file_info(f"{base}/{PENDING}").type == fs.FileType.Directory and not store.get_file_info(rest):
            store.delete_dir(f"{base}/{PENDING}")


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["root"], uuid.uuid4().hex)


def write_files(files: DataFrame, root: str) -> None:
    """Write the rows ``path, content`` of ``files`` below ``root``: all of them, or none if the job fails."""
    files.sparkSession.dataSource.register(WholeFiles)
    files.selectExpr("CAST(path AS STRING) AS path", "CAST(content AS BINARY) AS content").write.format(NAME).mode("append").option("root", root).save()
