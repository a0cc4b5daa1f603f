"""A folder as a stream of file changes: a data source whose offsets are listings.

Every trigger takes a new listing; its rows are what leads from the listing of the last offset to it: `add`, `change`
(another size or time) and `unlink`. The folder is dealt into directories of a given depth. A task lists one of them,
writes that part of the listing, sorted by path, below the `state` folder, and merges it with the same part of the listing
before. The driver sees the directories of that depth, never files. A repeated task finds the part it wrote the first
time and gives the same rows.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("folder_changes").option("path", "/corpus").option("state", "/shared/corpus-listings").load()
"""

from __future__ import annotations

import datetime
import hashlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from docstrata.sources.walk import _opened

SCHEMA = "path string, op string, size_bytes long, mtime_ms long, ts timestamp, event_id long, fingerprint string"
_KINDS = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("mtime_ms", pa.int64())])

Entry = tuple[str, int, int]


@dataclass
class Part(InputPartition):
    """A directory, whether with all below it or its own files only, and the listings to compare."""

    directory: str
    deep: bool
    before: int
    after: int


def _name(directory: str, deep: bool) -> str:
    return hashlib.md5(f"{directory}:{deep}".encode()).hexdigest() + ".parquet"


def _entries(system: pafs.FileSystem, directory: str, deep: bool) -> list[pafs.FileInfo]:
    return system.get_file_info(pafs.FileSelector(directory, recursive=deep, allow_not_found=True))


def list_part(directory: str, deep: bool) -> list[Entry]:
    """The files of a directory, by path. One that is gone has none."""
    system, inner, front = _opened(directory)
    found = [i for i in _entries(system, inner, deep) if i.type == pafs.FileType.File]
    return sorted((front + i.path, i.size, (i.mtime_ns or 0) // 1_000_000) for i in found)


def changes(before: Iterator[Entry], after: Iterator[Entry]) -> Iterator[tuple[str, Entry]]:
    """(op, entry) of the merge of two listings in order of their paths."""
    before, after = iter(before), iter(after)
    old, new = next(before, None), next(after, None)
    while old or new:
        if new is None or (old is not None and old[0] < new[0]):
            yield "unlink", old
            old = next(before, None)
        elif old is None or new[0] < old[0]:
            yield "add", new
            new = next(after, None)
        else:
            if old != new:
                yield "change", new
            old, new = next(before, None), next(after, None)


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["path"].rstrip("/") or "/", options["state"].rstrip("/")
        self.depth = int(options.get("depth", 1))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": time.time_ns() // 1_000_000}

    def _directories(self, listing: int) -> set[tuple[str, bool]]:
        system, inner, _ = _opened(self.state)
        path = f"{inner}/{listing}/parts.parquet"
        if not listing or system.get_file_info(path).type != pafs.FileType.File:
            return set()
        return {(r["directory"], r["deep"]) for r in pq.read_table(path, filesystem=system).to_pylist()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, after = start["listing"], end["listing"]
        now = self._directories(after)
        if not now:  # a repeated batch deals as it did the first time
            now, level = {(self.root, self.depth == 0)}, [self.root]
            for depth in range(self.depth):
                below = []
                for directory in level:
                    system, inner, front = _opened(directory)
                    below += [front + i.path for i in _entries(system, inner, False) if i.type == pafs.FileType.Directory]
                now |= {(d, depth + 1 == self.depth) for d in below}
                level = below
            rows = [{"directory": d, "deep": deep} for d, deep in sorted(now | self._directories(before))]
            _write(f"{self.state}/{after}", "parts.parquet", pa.Table.from_pylist(rows, pa.schema([("directory", pa.string()), ("deep", pa.bool_())])))
        # Directories of the last listing that are gone still have files to take back.
        return [Part(d, deep, before, after) for d, deep in sorted(now | self._directories(before))]

    def read(self, partition: Part) -> Iterator[tuple]:
        name = _name(partition.directory, partition.deep)
        old = _stored(f"{self.state}/{partition.before}", name) or []
        new = _stored(f"{self.state}/{partition.after}", name)
        if new is None:
            new = list_part(partition.directory, partition.deep)
            columns = [list(c) for c in zip(*new, strict=True)] if new else [[], [], []]
            _write(f"{self.state}/{partition.after}", name, pa.table(columns, schema=_KINDS))
        ts = datetime.datetime.fromtimestamp(partition.after / 1000, datetime.timezone.utc)
        for op, (path, size, mtime) in changes(old, new):
            mark = hashlib.md5(f"{path}:{size}:{mtime}".encode()).hexdigest()
            number = int.from_bytes(hashlib.md5(f"{path}:{op}:{partition.after}".encode()).digest()[:8], "big", signed=True)
            yield path, op, size, mtime, ts, number, mark

    def commit(self, end: dict) -> None:
        """Listings older than the one before `end` are not needed again."""
        system, inner, _ = _opened(self.state)
        held = [int(i.base_name) for i in _entries(system, inner, False) if i.base_name.isdigit()]
        for listing in sorted(n for n in held if n < end["listing"])[:-1]:
            system.delete_dir(f"{inner}/{listing}")


def _stored(folder: str, name: str) -> list[Entry] | None:
    system, inner, _ = _opened(folder)
    path = f"{inner}/{name}"
    if system.get_file_info(path).type != pafs.FileType.File:
        return None
    table = pq.read_table(path, filesystem=system)
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def _write(folder: str, name: str, table: pa.Table) -> None:
    """The file appears whole or not at all."""
    system, inner, _ = _opened(folder)
    system.create_dir(inner, recursive=True)
    draft = f"{inner}/.{name}-{uuid.uuid4().hex}"
    pq.write_table(table, draft, filesystem=system)
    system.move(draft, f"{inner}/{name}")


class FolderChanges(DataSource):
    """Options: `path`, the folder; `state`, a shared folder for listings, one for each stream; `depth` (1), that of the
    directories that tasks list."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)
