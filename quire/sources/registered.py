"""A data source over a folder of files, whose readers users register by extension."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from quire.sources.convert import convert, ext_of

SCHEMA = "path string, name string, ext string, length long, place int, text string, error string"
#: What a folder's listing tells of a file, so that a condition on it is decided before the file is opened.
LISTED = ("path", "name", "ext", "length")
#: Bytes of a task's files unless the option ``bytesPerPartition`` says else, and what opening a file counts beside its bytes.
PARTITION_BYTES = 128 << 20
OPEN_BYTES = 4 << 20
#: A batch is handed on once its texts pass this many characters.
BATCH_CHARS = 8 << 20

#: A reader makes one text of a file's bytes, or several.
Reader = Callable[[bytes], str | Iterable[str]]


@dataclass(frozen=True)
class Listed:
    """A file as its folder lists it; ``inner`` is its path for the file system."""

    path: str
    name: str
    ext: str
    length: int
    inner: str


@dataclass
class Files(InputPartition):
    files: list[Listed]


def file_system(folder: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder, the folder's path in it, and what stands before such a path in a full one."""
    folder = re.sub(r"^file:/+", "file:///", folder.rstrip("/"))
    system, base = fs.FileSystem.from_uri(folder)
    return system, base, folder.removesuffix(base)


def listed(folder: str) -> list[Listed]:
    """The files below a folder by path; as Spark does, without those that a name with "_" or "." in front hides."""
    system, base, before = file_system(folder)
    out = []
    for f in system.get_file_info(fs.FileSelector(base, recursive=True)):
        parts = f.path.removeprefix(base).strip("/").split("/")
        if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in parts):
            out.append(Listed(before + f.path, parts[-1], ext_of(parts[-1]), f.size, f.path))
    return sorted(out, key=lambda f: f.path)


def passes(condition: Filter, file: Listed) -> bool | None:
    """Whether a file meets a condition on what is listed of it; None for what can't be told by that."""
    if isinstance(condition, Not):
        met = passes(condition.child, file)
        return None if met is None else not met
    if len(condition.attribute) != 1 or condition.attribute[0] not in LISTED:
        return None
    own = getattr(file, condition.attribute[0])
    match condition:
        case IsNotNull():
            return True
        case In() if None not in condition.value:
            return own in condition.value
        case EqualTo():
            return own == condition.value
        case GreaterThan():
            return own > condition.value
        case GreaterThanOrEqual():
            return own >= condition.value
        case LessThan():
            return own < condition.value
        case LessThanOrEqual():
            return own <= condition.value
        case StringStartsWith():
            return own.startswith(condition.value)
        case StringEndsWith():
            return own.endswith(condition.value)
        case StringContains():
            return condition.value in own
    return None


class FilesReader(DataSourceReader):
    def __init__(self, folder: str, readers: dict[str, Reader], budget: int) -> None:
        self.folder, self.readers, self.budget = folder, readers, budget
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes the conditions that a listing decides; the others are Spark's."""
        probe = Listed("", "", "", 0, "")
        for condition in filters:
            if passes(condition, probe) is None:
                yield condition
            else:
                self.conditions.append(condition)

    def partitions(self) -> list[Files]:
        """Files in order of path, as many in a partition as the budget of bytes holds, one at least."""
        out: list[Files] = []
        room = 0
        for file in listed(self.folder):
            if not all(passes(c, file) for c in self.conditions):
                continue
            cost = file.length + OPEN_BYTES
            if not out or cost > room:
                out.append(Files([]))
                room = self.budget
            out[-1].files.append(file)
            room -= cost
        return out

    def texts(self, data: bytes, ext: str) -> Iterator[tuple[int, str | None, str | None]]:
        """(place, text, error) of what the reader of an extension makes; a failing one's last row says why."""
        place = 0
        try:
            made = self.readers[ext](data) if ext in self.readers else convert(data, ext)
            for text in [made] if isinstance(made, str) else made:
                yield place, text, None
                place += 1
        except Exception as error:
            yield place, None, f"{type(error).__name__}: {error}"

    def rows(self, files: list[Listed]) -> Iterator[tuple]:
        system, _, _ = file_system(self.folder)
        for f in files:
            # what can't be opened ends the task, which Spark tries again; what can't be read is a row
            with system.open_input_stream(f.inner) as stream:
                data = stream.read()
            for found in self.texts(data, f.ext):
                yield f.path, f.name, f.ext, f.length, *found

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("ext", pa.string()), ("length", pa.int64()), ("place", pa.int32()), ("text", pa.string()), ("error", pa.string())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        held: list[tuple] = []
        size = 0
        for row in self.rows(partition.files if partition else []):
            held.append(row)
            size += len(row[5] or "") + len(row[0])
            if size > BATCH_CHARS:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


class FilesSource(DataSource):
    """What ``register_files`` registers with readers of its own."""

    readers: dict[str, Reader] = {}
    format = "quire_files"

    @classmethod
    def name(cls) -> str:
        return cls.format

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"], self.readers, int(self.options.get("bytesPerPartition", PARTITION_BYTES)))


def register_files(spark: SparkSession, readers: dict[str, Reader] | None = None, name: str = FilesSource.format) -> None:
    """Registers a format that reads all files below a folder, each by the reader of its extension.

    ``spark.read.format(name).load(folder)`` then gives (path, name, ext, length,
    place, text, error): a row per text that a reader makes, numbered from 0 by
    file. ``readers`` goes before the library's own Markdown conversion; an
    extension that neither knows is fenced as it is. A reader that fails gives a
    row with the error behind the texts that it made; one that makes nothing
    gives no row, as an empty folder does. Texts may be null.

    Conditions on path, name, ext and length are taken by the source: files that they rule out are
    never opened. A task reads files up to ``bytesPerPartition`` together (128 MB unless
    the option says else); one file is one task's work. Files are opened through
    Arrow's file systems (local folders, HDFS, object stores), by the tasks;
    only the listing goes through the driver. Readers go to the tasks by value. The session
    comes to push conditions into Python sources, which Spark leaves off by default.
    """
    known = {ext.lower().removeprefix("."): reader for ext, reader in (readers or {}).items()}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(type("RegisteredFiles", (FilesSource,), {"readers": known, "format": name}))
