"""Document folders and graph exports as Spark data sources.

``spark.read.format("documents")`` and ``spark.readStream.format("documents")`` read the files under ``path``: one row a file, as ``read_documents`` gives them. A partition holds
files of about ``partitionBytes``; a stream's offset is the time of the newest file that it has seen, and the names of the files of that time. ``df.write.format("graph")`` writes lines of an export
(``line``, in the order of ``part`` and ``id`` inside a task) as files that count only once the whole write is committed; a write that fails leaves nothing.

Files are reached through ``pyarrow``'s file systems, by the scheme of the path: local paths, and those of stores that it knows. For stores that only Spark can open
there is ``documents.read_documents``.

Defined results: names that begin with ``.`` or ``_`` are no documents; files whose extension is not one of ``EXTENSIONS`` are left out, unless the option ``unsupported`` is ``keep``, which gives
a row with an error; an empty folder is an empty table; a folder that does not exist is an error. A file that is written again while a stream runs is a new file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .documents import EXTENSIONS, parsed

PARTITION_BYTES = 64 << 20
SCHEMA = "path string, extension string, modified timestamp, size long, text string, title string, author string, error string"


def _opened(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inside.rstrip("/")


def _listed(path: str, unsupported: str) -> list[tuple[int, str, int]]:
    """``time in ns, path, size`` of the documents under a path, oldest first."""
    from pyarrow import fs

    system, root = _opened(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        names = info.path[len(root) :].strip("/").split("/")
        if info.type == fs.FileType.File and not any(n[0] in "._" for n in names) and (unsupported == "keep" or info.extension.lower() in EXTENSIONS):
            out.append((info.mtime_ns or 0, info.path, info.size))
    return sorted(out)


@dataclass
class Files(InputPartition):
    files: list[tuple[int, str, int]]


def _dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Files in partitions of about ``most`` bytes; a larger file has one of its own."""
    parts, size = [Files([])], 0
    for f in files:
        if parts[-1].files and size + f[2] > most:
            parts.append(Files([]))
            size = 0
        parts[-1].files.append(f)
        size += f[2]
    return parts if parts[-1].files else []


def _rows(root: str, part: Files) -> Iterator[tuple]:
    from datetime import datetime, timezone

    system, _ = _opened(root)
    for time, path, size in part.files:
        with system.open_input_stream(path) as f:
            data = f.read()
        extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        p = parsed(extension, data)
        yield path, extension, datetime.fromtimestamp(time / 1e9, timezone.utc), size, p["text"], p["title"], p["author"], p["error"]


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.unsupported = options["path"], options.get("unsupported", "skip")
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.path, self.unsupported), self.bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are ``time`` and ``names``: all files before that time were seen, and of that time those of the names."""

    def __init__(self, options: dict):
        self.path, self.unsupported = options["path"], options.get("unsupported", "skip")
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"time": -1, "names": "[]"}

    def latestOffset(self) -> dict:
        files = _listed(self.path, self.unsupported)
        newest = files[-1][0] if files else -1
        return {"time": newest, "names": json.dumps([p for t, p, _ in files if t == newest])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before, after = set(json.loads(start["names"])), set(json.loads(end["names"]))
        wanted = [f for f in _listed(self.path, self.unsupported) if self._in(f, start, before, True) and self._in(f, end, after, False)]
        return _dealt(wanted, self.bytes)

    @staticmethod
    def _in(file: tuple[int, str, int], offset: dict, names: set[str], beyond: bool) -> bool:
        """Whether a file lies beyond an offset, or not beyond it."""
        seen = file[0] < offset["time"] or file[0] == offset["time"] and file[1] in names
        return seen != beyond

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str
    lines: int


class GraphExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite, schema.names)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, names: list[str]):
        if "line" not in names:
            raise ValueError("an export has a column line")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _beside(self, root: str) -> str:
        return f"{root}/_writing-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        system, root = _opened(self.path)
        context = TaskContext.get()
        # an attempt has a file of its own, so that one that was lost does not mix with the next
        name = f"part-{context.partitionId():05}-{context.taskAttemptId()}.txt"
        system.create_dir(self._beside(root), recursive=True)
        lines = 0
        with system.open_output_stream(f"{self._beside(root)}/{name}") as out:
            for row in rows:
                out.write((row["line"] + "\n").encode())
                lines += 1
        return Written(name, lines)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _opened(self.path)
        system.create_dir(self._beside(root), recursive=True)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        # only what tasks that ended have told of; what other attempts wrote goes with the folder
        for m in messages:
            if m is not None and m.lines:
                system.move(f"{self._beside(root)}/{m.name}", f"{root}/{m.name.rsplit('-', 1)[0]}-{self.job}.txt")
        system.delete_dir(self._beside(root))
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _opened(self.path)
        if system.get_file_info(self._beside(root)).type == fs.FileType.Directory:
            system.delete_dir(self._beside(root))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(DocumentSource)
    spark.dataSource.register(GraphExport)
