"""A vault of Markdown notes as a Python Data Source: spark.read.format("notes_vault") and readStream.

Options: path (any store that pyarrow opens), excluded (folder names with commas between them, in place of the usual ones), partitions (how many at least, if there are as many folders, or files enough).

Planning lists folders level by level only until there are enough of them to deal out; each task lists what lies below its
own folders, and its share of the files in those above, and reads the files one after the other. A folder of many files is so read by many tasks. As a stream, the offset is the greatest (mtime, path, size) that has been
read, in this order: a later trigger takes the files that were written since, changed ones too. A file that is put in with an
older time than what was read isn't seen, as with Spark's own file streams past their age limit.

Defined results: files end in .md or .markdown; excluded folders are left out at any depth; relative paths have /; the hash is
that of the file's bytes, the text is without a byte order mark; bytes that aren't UTF-8, and a root that isn't there, are errors.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import qualified
from .vault import EXCLUDED

SCHEMA = "relative_path string, text string, content_hash string, byte_size long, modified_ns long"
ENDINGS = (".md", ".markdown")
#: Bytes of a batch that a task hands on.
HELD = 8 << 20
#: Files of the folders above the dealt ones for which there is another task.
SHARED = 128


class NotUtf8(ValueError):
    pass


@dataclass
class Folders(InputPartition):
    """Folders of one task: with what lies below them (deep), or only its share (this of so many) of their own files (flat); files after `after` up to `upto` (mtime, path, size)."""

    deep: list[str]
    flat: list[str]
    share: tuple[int, int] = (0, 1)
    after: tuple | None = None
    upto: tuple | None = None


class Listing:
    def __init__(self, options: dict):
        self.store, self.root = fs.FileSystem.from_uri(options["path"])
        self.root = self.root.rstrip("/")
        self.excluded = set(options["excluded"].split(",")) if "excluded" in options else set(EXCLUDED)
        self.partitions = int(options.get("partitions", "32"))

    def inside(self, folder: str) -> tuple[list[fs.FileInfo], list[str]]:
        """The notes in a folder, and the folders in it."""
        found = self.store.get_file_info(fs.FileSelector(folder))
        notes = [i for i in found if i.type == fs.FileType.File and i.base_name.endswith(ENDINGS)]
        return notes, [i.path for i in found if i.type == fs.FileType.Directory and i.base_name not in self.excluded]

    def dealt(self) -> list[Folders]:
        """Level by level, until there are enough folders or none has another in it."""
        if self.store.get_file_info(self.root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"there is no folder {self.root}: make it, or check that its drive is there")
        level, flat, files = [self.root], [], 0
        while level and len(level) < self.partitions:
            below = []
            for parent in level:
                notes, folders = self.inside(parent)
                below += folders
                files += len(notes)
                flat += [parent] if notes else []
            level = below
        n = max(1, min(self.partitions, len(level) + -(-files // SHARED)))
        tasks = [Folders([], sorted(flat), (k, n)) for k in range(n)]
        for k, folder in enumerate(sorted(level)):
            tasks[k % n].deep.append(folder)
        return tasks

    def notes(self, part: Folders) -> Iterator[tuple[tuple, str]]:
        """(mtime, relative path, size) and path of the task's files."""
        rest = [(folder, True) for folder in part.deep] + [(folder, False) for folder in part.flat]
        own, of = part.share
        while rest:
            folder, deep = rest.pop()
            notes, folders = self.inside(folder)
            rest += [(f, True) for f in folders] if deep else []
            for i in sorted((i for i in notes if deep or zlib.crc32(i.base_name.encode()) % of == own), key=lambda i: i.path):
                at = (i.mtime_ns, i.path[len(self.root) + 1 :].replace("\\", "/"), i.size)
                if (part.after is None or at > tuple(part.after)) and (part.upto is None or at <= tuple(part.upto)):
                    yield at, i.path

    def rows(self, part: Folders) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (modified, relative, _), path in self.notes(part):
            with self.store.open_input_stream(path, compression=None) as file:
                raw = file.read()
            try:
                text = raw.decode("utf-8-sig")
            except UnicodeDecodeError as e:
                raise NotUtf8(f"{relative} isn't UTF-8: {e.reason} at byte {e.start}") from None
            held.append((relative, text, hashlib.sha256(raw).hexdigest(), len(raw), modified))
            size += len(raw)
            if size >= HELD:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["relative_path", "text", "content_hash", "byte_size", "modified_ns"])


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return Listing(self.options).dealt()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from Listing(self.options).rows(partition)


class VaultStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"at": None}

    def latestOffset(self) -> dict:
        listing = Listing(self.options)
        last = max((at for part in listing.dealt() for at, _ in listing.notes(part)), default=None)
        return {"at": None if last is None else json.dumps(last)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (None if o["at"] is None else tuple(json.loads(o["at"])) for o in (start, end))
        if upto is None:
            return []
        found = Listing(self.options).dealt()
        for part in found:
            part.after, part.upto = after, upto
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from Listing(self.options).rows(partition)


class VaultFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes_vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VaultReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return VaultStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultFormat)


def notes(spark: SparkSession, root: str, stream: bool = False, **options: str):
    """A vault's notes as a table, or as a stream."""
    register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format("notes_vault").options(path=qualified(spark, root), **options).load()
