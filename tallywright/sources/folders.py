"""Folders of files: listing and reading in tasks, and sets of named files.

Folders are listed level by level, each folder by a task, so the driver never holds a
list of files; contents are dealt out evenly, however the files lie in their folders.
Paths without a scheme, or with `file:`, are read from the file system that all machines
share; any other scheme is left to Arrow's file systems (s3, gs, hdfs).
"""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from tallywright.session import shared_folder, ship

ship(__name__)

NAMED_FILES = "named_files"
_BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_ROWS = 2048
_TASK_BYTES = 64 << 20
_LISTED = pa.schema(
    [
        ("folder", pa.bool_()),
        ("file_name", pa.string()),
        ("path", pa.string()),
        ("size_bytes", pa.int64()),
        ("modified_at", pa.timestamp("us", "UTC")),
    ]
)


class _Shared:
    """The file system that all machines see under the same paths."""

    @staticmethod
    def plain(path: str) -> str:
        return re.sub(r"^file:/*", "/", path)

    def children(self, folder: str) -> Iterator[tuple]:
        """(is a folder, name, path, bytes, time of change) of all entries, in any order."""
        with os.scandir(self.plain(folder)) as entries:
            for entry in entries:
                # a link to a folder is not followed, so a loop of links ends nowhere
                if entry.is_dir(follow_symlinks=False):
                    yield True, entry.name, f"{folder}/{entry.name}", None, None
                elif entry.is_file():
                    yield False, entry.name, f"{folder}/{entry.name}", *self._facts(entry.stat())

    @staticmethod
    def _facts(stat: os.stat_result) -> tuple[int, datetime]:
        return stat.st_size, datetime.fromtimestamp(stat.st_mtime_ns // 1000 / 1e6, timezone.utc)

    def itself(self, path: str) -> tuple | None:
        """As a child, if it is there."""
        plain, name = self.plain(path), path.rsplit("/", 1)[-1]
        if os.path.isdir(plain):
            return True, name, path, None, None
        return (False, name, path, *self._facts(os.stat(plain))) if os.path.isfile(plain) else None

    def read(self, path: str) -> bytes:
        with open(self.plain(path), "rb") as file:
            return file.read()

    def write(self, path: str, content: bytes | pa.Buffer) -> None:
        """The file appears under its name with all its content, or not at all."""
        plain = self.plain(path)
        part = f"{os.path.dirname(plain)}/.{uuid.uuid4().hex}"
        with open(part, "wb") as file:
            file.write(content)
        os.replace(part, plain)

    def make(self, folder: str) -> None:
        os.makedirs(self.plain(folder), exist_ok=True)

    def move(self, old: str, new: str) -> None:
        os.rename(self.plain(old), self.plain(new))

    def remove(self, folder: str) -> None:
        shutil.rmtree(self.plain(folder), ignore_errors=True)


class _Remote:
    """A file system of Arrow, named by the scheme of the path."""

    def __init__(self, path: str) -> None:
        self.system, _ = fs.FileSystem.from_uri(path)

    def plain(self, path: str) -> str:
        return fs.FileSystem.from_uri(path)[1]

    def _row(self, info: fs.FileInfo, path: str) -> tuple:
        if info.type == fs.FileType.Directory:
            return True, info.base_name, path, None, None
        return False, info.base_name, path, info.size, info.mtime

    def children(self, folder: str) -> Iterator[tuple]:
        for info in self.system.get_file_info(fs.FileSelector(self.plain(folder))):
            yield self._row(info, f"{folder}/{info.base_name}")

    def itself(self, path: str) -> tuple | None:
        info = self.system.get_file_info(self.plain(path))
        return None if info.type == fs.FileType.NotFound else self._row(info, path)

    def read(self, path: str) -> bytes:
        with self.system.open_input_stream(self.plain(path)) as file:
            return file.read()

    def write(self, path: str, content: bytes | pa.Buffer) -> None:
        with self.system.open_output_stream(self.plain(path)) as file:
            file.write(content)

    def make(self, folder: str) -> None:
        self.system.create_dir(self.plain(folder))

    def move(self, old: str, new: str) -> None:
        self.system.move(self.plain(old), self.plain(new))

    def remove(self, folder: str) -> None:
        if self.itself(folder):
            self.system.delete_dir(self.plain(folder))


def _system(path: str) -> _Shared | _Remote:
    return _Remote(path) if "://" in path and not path.startswith("file:") else _Shared()


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_LISTED.names, row)) for row in rows], _LISTED)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            for child in _system(folder).children(folder):
                held.append(child)
                if len(held) >= _BATCH_ROWS:
                    yield _listed(held)
                    held = []
    if held:
        yield _listed(held)


def _fixed_part(path: str) -> tuple[str, list[str]]:
    """The folder in front of the first wildcard, and the parts of the pattern behind."""
    parts = path.rstrip("/").split("/")
    wild = next((i for i, part in enumerate(parts) if re.search(r"[*?\[{]", part)), len(parts))
    return "/".join(parts[:wild]) or "/", parts[wild:]


def _as_regex(pattern: str) -> str:
    """A part of a path pattern: *, ?, [...] and {a,b} as Spark's readers take them."""
    choices = re.split(r"\{([^{}]*)\}", pattern)
    out = ""
    for i, piece in enumerate(choices):
        options = piece.split(",") if i % 2 else [piece]
        bodies = [re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(o)) for o in options]
        out += f"(?:{'|'.join(bodies)})"
    return out


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, path, size_bytes, modified_at) of every file below a path, none left out.

    A path is a file, a folder, or a pattern whose matches are either. Empty files, names
    that start with `_` or `.` and files at any depth are listed; links to folders are
    not followed. Every level of folders is one job, written to the shared folder, so
    the listing is the same however often it is used; a missing path gives no rows.
    """
    root, pattern = _fixed_part(path)
    start = _system(root).itself(root)
    top = spark.createDataFrame(_table([start] if start else []))
    found = top.where("NOT folder")
    level = top.where("folder").select("path")
    while level.head(1):
        place = f"{shared_folder(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
        children = level.repartition(_tasks(spark), "path").mapInArrow(_children, top.schema)
        if pattern:
            name, deeper = pattern[0], pattern[1:]
            children = children.where(F.col("file_name").rlike(f"^{_as_regex(name)}$"))
            if deeper:  # a file in place of a folder is no match
                children = children.where("folder")
            pattern = deeper
        children.write.parquet(place)
        children = spark.read.schema(top.schema).parquet(place)
        found = found.unionByName(children.where("NOT folder"))
        level = children.where("folder").select("path")
    return found.drop("folder")


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_listed(rows)], _LISTED) if rows else _LISTED.empty_table()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        paths, contents = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"]
        )

    for listed in batches:
        for path in listed.column("path").to_pylist():
            content = _system(path).read(path)
            held.append((path, content))
            size += len(content)
            if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_files(files: DataFrame) -> DataFrame:
    """(path, content) of the files of a listing, dealt evenly to tasks.

    As many tasks as a shuffle has, or one for each 64 MB of the listed sizes. The
    number is fixed here, as the plan sees only the short paths that are dealt out.
    """
    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(_tasks(files.sparkSession), total // _TASK_BYTES)
    return files.select("path").repartition(tasks, "path").mapInArrow(_contents, "path string, content binary")


# --- sets of named files ---------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _NamedFilesWriter(DataSourceArrowWriter):
    """Contents go from Arrow's buffers into their files and never become Python text."""

    def __init__(self, path: str, staging: str, columns: list[str]) -> None:
        self.path, self.staging = path, staging
        self.name, self.content = (columns.index(c) for c in ("file_name", "content"))

    def write(self, iterator) -> _Written:
        system, count = _system(self.staging), 0
        for batch in iterator:
            contents = batch.column(self.content)
            for name, content in zip(batch.column(self.name).to_pylist(), contents):
                if not name or "/" in name or "\0" in name or name in (".", ".."):
                    raise ValueError(f"no name for a file: {name!r}")
                data = content.as_buffer()
                system.write(f"{self.staging}/{name}", b"" if data is None else data)
                count += 1
        return _Written(count)

    def commit(self, messages) -> None:
        system = _system(self.path)
        old = f"{self.staging}-old"
        if system.itself(self.path):
            system.move(self.path, old)
        system.move(self.staging, self.path)
        system.remove(old)

    def abort(self, messages) -> None:
        _system(self.staging).remove(self.staging)


class NamedFiles(DataSource):
    """Sink of rows (file_name, content): one file each, the whole set at once."""

    @classmethod
    def name(cls) -> str:
        return NAMED_FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _NamedFilesWriter(self.options["path"], self.options["staging"], schema.fieldNames())


def write_files(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store each row (file_name, content) as a file of exactly that name in a folder.

    Tasks write into a hidden folder beside the target; a file takes its name there once
    it is complete, so a task run twice leaves one file. When all tasks are done the
    folder is renamed to the target, and after a failure it is removed: readers see the
    whole set or none of it. A task holds a batch of about 16 MB, or one row. `mode` is errorifexists or overwrite. Content is text
    (UTF-8) or bytes, a missing one is an empty file. A name that is missing, empty,
    given twice or not a plain file name is refused.
    """
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError(f"mode {mode}: a set of files is new or replaces another")
    spark, path = df.sparkSession, path.rstrip("/")
    system = _system(path)
    if mode != "overwrite" and system.itself(path):
        raise FileExistsError(path)
    rows = df.select("file_name", "content")
    twice = rows.groupBy("file_name").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"two files of the name {twice[0]['file_name']!r}")
    parent, name = path.rsplit("/", 1)
    staging = f"{parent}/.{name}-{uuid.uuid4().hex}"
    system.make(staging)
    spark.dataSource.register(NamedFiles)
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, str(_BATCH_BYTES))
    try:
        writer = rows.write.format(NAMED_FILES).mode("append")
        writer.option("path", path).option("staging", staging).save()
    finally:
        spark.conf.unset(_BATCH_SETTING) if before is None else spark.conf.set(_BATCH_SETTING, before)
        system.remove(staging)
