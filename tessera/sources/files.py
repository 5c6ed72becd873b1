"""Files of a folder as a Spark data source, in batch and as a stream: names are listed and files read in tasks.

``spark.dataSource.register(FileSource)``, then ``spark.read.format("files").load(path)`` gives (path, name, size, modified, content): name is the path below the folder, files without a byte are rows too. Partitions are prefixes: the driver
lists folders from the top only until there are ``partitions`` of them, and each task lists what lies below its own. Options: ``suffixes`` (without a dot, by commas; others have no content), ``content`` (``false``: names and sizes only).

As a stream, offsets are times: a batch has the files modified after the last one and at least ``lag`` seconds ago, so neither names nor states of files are kept, and files seen are not read again. A file that appears with
an older time than the last offset (a move that keeps its time) is not seen.

Paths are local (or on a shared mount), or of a store that Arrow reads (s3, gs, hdfs).
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of content that a task holds before it hands rows on.
BATCH_BYTES = 16 << 20
_SHAPE = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("content", pa.binary())])


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. Local URIs may have one or three slashes."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/") or "/"
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside.rstrip("/")


def readable(path: str) -> bool:
    """Whether Arrow reads this store."""
    return path.startswith(("/", "file:", "s3://", "gs://", "hdfs://"))


class Prefix(InputPartition):
    """A folder: all below it, or only the files that lie in it directly; modified after ``since`` and up to ``until`` (nanoseconds)."""

    def __init__(self, path: str, deep: bool, since: int = -1, until: int | None = None) -> None:
        self.path, self.deep, self.since, self.until = path, deep, since, until


class _Files:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.wanted = int(options.get("partitions", 64))
        self.suffixes = tuple(f".{s.strip().lower()}" for s in options.get("suffixes", "").split(",") if s.strip())
        self.content = options.get("content", "true").lower() == "true"

    def prefixes(self, since: int = -1, until: int | None = None) -> list[Prefix]:
        store, root = place_of(self.path)
        flat, deep = [], [root]
        while deep and len(flat) + len(deep) < self.wanted:
            below = []
            for folder in deep:
                below += [x.path for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.Directory]
            if not below:
                break
            flat, deep = flat + deep, below
        return [Prefix(p, False, since, until) for p in flat] + [Prefix(p, True, since, until) for p in deep]

    def rows(self, part: Prefix) -> Iterator[pa.RecordBatch]:
        store, root = place_of(self.path)
        held: list[dict] = []
        size = 0
        for x in store.get_file_info(fs.FileSelector(part.path, recursive=part.deep, allow_not_found=True)):
            at = x.mtime_ns or 0
            if x.type != fs.FileType.File or at <= part.since or part.until is not None and at > part.until:
                continue
            content = None
            if self.content and (not self.suffixes or x.path.lower().endswith(self.suffixes)):
                with store.open_input_stream(x.path) as stream:
                    content = stream.read()
            held.append({"path": x.path, "name": x.path[len(root) :].lstrip("/"), "size": x.size, "modified": x.mtime, "content": content})
            size += 256 + len(content or b"")
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, _SHAPE)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _SHAPE)


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = _Files(options)

    def partitions(self) -> list[Prefix]:
        return self.files.prefixes() or [Prefix(place_of(self.files.path)[1], True)]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class FileStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.lag = _Files(options), float(options.get("lag", 2))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.lag * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Prefix]:
        return self.files.prefixes(start["until"], end["until"])

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, name string, size long, modified timestamp, content binary"

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))

    def streamReader(self, schema) -> FileStream:
        return FileStream(dict(self.options))
