"""A Spark data source for the first bytes of files.

`spark.read.format("file_heads").option("bytes", 8).load(path)` gives path, length
and head of every file below a folder, of one file, or of a pattern in the last
steps of the path. Only the listing and the wanted bytes are read, whatever the
files' size; files are dealt out to tasks in groups. Any file system that Arrow
knows will do (local, HDFS, object stores).
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, head binary"
FILES_PER_TASK = 500


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path on it, and what stands before the path in Spark's names."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.index(inner)] if inner in path else path.split("://")[0] + "://"


def _hidden(path: str) -> bool:
    return any(step.startswith(("_", ".")) for step in path.split("/"))


def list_files(path: str) -> list[str]:
    """Files of a folder and all below it, of one file, or of a pattern, as paths of the file system; hidden ones are left out."""
    system, inner, _ = _opened(path)
    steps = inner.rstrip("/").split("/")
    fixed = next((i for i, s in enumerate(steps) if any(c in s for c in "*?[")), len(steps))
    base = "/".join(steps[:fixed]) or "/"
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info.path]
    wanted = "/".join(steps[fixed:])
    found = []
    for f in system.get_file_info(fs.FileSelector(base, recursive=True)):
        below = f.path[len(base):].lstrip("/")
        depth = "/".join(below.split("/")[: len(steps) - fixed])
        if f.type == fs.FileType.File and not _hidden(below) and (not wanted or fnmatch.fnmatchcase(depth, wanted)):
            found.append(f.path)
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"], int(options.get("bytes", 8))
        self.group = int(options.get("filesPerTask", FILES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        paths = list_files(self.path)
        return [_Files(paths[i : i + self.group]) for i in range(0, len(paths), self.group)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _, before = _opened(self.path)
        for at in range(0, len(partition.paths), 100):
            rows = []
            for path in partition.paths[at : at + 100]:
                with system.open_input_file(path) as file:
                    size = file.size()
                    rows.append((before + quote(path, safe="/=,:@+&$!*'()~;"), size, file.read_at(min(self.bytes, size), 0)))
            paths, sizes, heads = zip(*rows)
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary())], names=["path", "length", "head"])


class FileHeads(DataSource):
    """Options: path, bytes (8), filesPerTask (500)."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(dict(self.options))


def file_heads(spark: SparkSession, path: str, size: int):
    """path, length and the first `size` bytes of every file."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("bytes", size).load(path)
