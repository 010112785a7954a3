"""A folder watched as a stream whose offsets are snapshots, and tables of state that a stream keeps."""

from __future__ import annotations

import heapq
import io
import json
import os
import pickle
import posixpath
import stat
import tempfile
import time
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby, islice, zip_longest
from operator import itemgetter
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.trees import opened

#: Partitions that a batch of changes is read in.
SHARDS = 8
#: Files of a listing that are sorted at once; more are sorted part by part on disk.
SORTED = 50_000
#: Files that are written and read as one.
BLOCK = 500


class _Shard(InputPartition):
    def __init__(self, start: int, end: int, number: int):
        self.start, self.end, self.number = start, end, number


def _inside(place, folder: str, to: str, deep: bool) -> Iterator[list]:
    """[path, size, time] of the files in a folder, and with deep below it; paths begin with `to` in place of the folder's. A local folder is gone through name by name; pyarrow tells other stores' files all at once."""
    from pyarrow import fs

    if not isinstance(place, fs.LocalFileSystem):
        for x in place.get_file_info(fs.FileSelector(folder, recursive=deep, allow_not_found=True)):
            if x.type == fs.FileType.File:
                yield [f"{to}/{posixpath.relpath(x.path, folder)}", x.size, x.mtime_ns]
        return
    try:
        names = os.scandir(folder)
    except FileNotFoundError:
        return
    with names:
        for name in names:
            try:
                at = name.stat()
            except FileNotFoundError:  # gone meanwhile, or a link that leads nowhere
                continue
            if stat.S_ISREG(at.st_mode):
                yield [f"{to}/{name.name}", at.st_size, at.st_mtime_ns]
            elif deep and stat.S_ISDIR(at.st_mode):
                yield from _inside(place, name.path, f"{to}/{name.name}", deep)


def _batched(rows: Iterable[list], n: int) -> Iterator[list[list]]:
    rows = iter(rows)
    while block := list(islice(rows, n)):
        yield block


def _part(spill: IO[bytes], start: int, end: int) -> Iterator[list]:
    """The rows between two places of a file that other parts are read from in turn."""
    while start < end:
        spill.seek(start)
        rows = pickle.load(spill)
        start = spill.tell()
        yield from rows


class _Listing:
    """Rows [path, ...] in any order, given back in the order of their paths, each path once; over SORTED rows they lie in a temporary file."""

    def __init__(self, rows: Iterator[list], spill: IO[bytes]):
        self.spill, self.ends, self.rest = spill, [0], []
        for row in rows:
            self.rest.append(row)
            if len(self.rest) == SORTED:
                for block in _batched(sorted(self.rest), BLOCK):
                    pickle.dump(block, spill)
                self.ends.append(spill.tell())
                self.rest = []
        self.rest.sort()

    def __iter__(self) -> Iterator[list]:
        parts = [_part(self.spill, *x) for x in zip(self.ends, self.ends[1:], strict=False)]
        last = None
        for row in heapq.merge(*parts, self.rest):
            if row[0] != last:
                last = row[0]
                yield row


def _differing(old: Iterator[list], new: Iterator[list]) -> Iterator[tuple[str, list | None, list | None]]:
    """(path, old, new) of the paths whose rows differ; both are in the order of their paths."""
    sided = lambda rows, side: ((path, side, at) for path, *at in rows)
    for path, found in groupby(heapq.merge(sided(old, 0), sided(new, 1)), itemgetter(0)):
        at = {side: x for _, side, x in found}
        if at.get(0) != at.get(1):
            yield path, at.get(0), at.get(1)


class _Changes(DataSourceStreamReader):
    """Offsets are versions of snapshots: what files a folder held, with their sizes and times. A snapshot is written before its version is ever given out, so a batch can be read again after a restart.

    A snapshot has its files in the order of their paths, BLOCK of them in a line, so two are
    compared file by file and neither the driver nor a task ever holds all of a folder's.
    """

    def __init__(self, root: str, state: str, entries: list[str]):
        self.root, self.state, self.entries = root, state, entries

    def _file(self, version: int) -> str:
        return posixpath.join(opened(self.state)[1], f"snapshot-{version:012d}.json")

    def _read(self, version: int) -> Iterator[list]:
        if version == 0:
            return
        with opened(self.state)[0].open_input_stream(self._file(version)) as f:
            for line in io.BufferedReader(f):
                rows = json.loads(line)
                # an earlier release wrote all files as one object
                yield from sorted([path, *at] for path, at in rows.items()) if isinstance(rows, dict) else rows

    def _latest(self) -> int:
        from pyarrow import fs

        place, base = opened(self.state)
        place.create_dir(base, recursive=True)
        found = [x.base_name for x in place.get_file_info(fs.FileSelector(base)) if x.base_name.startswith("snapshot-") and x.base_name.endswith(".json")]
        return max((int(x[9:-5]) for x in found), default=0)

    def _now(self) -> Iterator[list]:
        place, base = opened(self.root)
        for entry in self.entries:
            folder = posixpath.normpath(posixpath.join(base, entry))
            to = "/" + posixpath.relpath(folder, base)
            yield from _inside(place, folder, "" if to == "/." else to, entry != ".")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        version = self._latest()
        with tempfile.TemporaryFile() as spill:
            now = _Listing(self._now(), spill)
            if any(old != new for old, new in zip_longest(self._read(version), now)):
                place = opened(self.state)[0]
                part = self._file(version + 1) + ".part"
                with place.open_output_stream(part) as f:
                    for rows in _batched(now, BLOCK):
                        f.write(json.dumps(rows).encode() + b"\n")
                place.move(part, self._file(version + 1))
                version += 1
        return {"version": version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Shard(start["version"], end["version"], k) for k in range(SHARDS)]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        for path, old, new in _differing(self._read(partition.start), self._read(partition.end)):
            if zlib.crc32(path.encode()) % SHARDS == partition.number:
                raw = "create" if old is None else "remove" if new is None else "modify"
                yield partition.end, path, raw, (new or [None])[0]

    def commit(self, end: dict) -> None:
        place = opened(self.state)[0]
        for version in range(max(1, end["version"] - 9), end["version"]):  # what is behind a committed offset is never read again
            if place.get_file_info(self._file(version)).type.name != "NotFound":
                place.delete_file(self._file(version))


class FolderChanges(DataSource):
    """Format `folder_changes`: rows (version, path, raw, size) of files that were created, modified or removed between two looks at a folder.

    Options: path, the folder; state, a folder that all runs of the query share, beside its
    checkpoint; entries, comma-separated folders below path that are watched with all
    inside, `.` for the folder itself without its subfolders. Entries that are not there
    have no files. The driver looks at the folder, of which it holds SORTED files at a time where
    it is a local one; rows are made by SHARDS tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "version long, path string, raw string, size long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002
        return _Changes(self.options["path"], self.options["state"], self.options.get("entries", ".,content,sass,static,templates,themes").split(","))


def watch(spark: SparkSession, root: str, state: str, entries: str | None = None) -> DataFrame:
    """The changes of a folder as a stream with a column ts, for streaming.changes."""
    spark.dataSource.register(FolderChanges)
    reader = spark.readStream.format("folder_changes").option("path", root).option("state", state)
    stream = (reader.option("entries", entries) if entries else reader).load()
    return stream.withColumn("ts", F.col("version"))


class StateTable:
    """Rows by key that a stream keeps: every batch writes the whole table as a version of its own, named by the batch.

    A batch that is run again, after a restart, starts from the version before it and
    replaces its own, so the table is what one uninterrupted run leaves. KEPT versions stay.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        """Whole versions, oldest first; one that a stopped run has left half written is none."""
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(self._path("version=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in done)

    def read(self, before: int | None = None) -> DataFrame:
        """The latest version, or the latest one before a batch; empty without one."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/version={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def apply(self, rows: DataFrame, removed: DataFrame, batch: int) -> None:
        """Puts rows in by key and takes removed keys out."""
        from .changes import upsert

        after = upsert(self.read(before=batch), rows, removed, self.key)
        after.write.mode("overwrite").parquet(f"{self.folder}/version={batch}")
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in self.versions()[: -self.KEPT]:
            fs.delete(self._path(f"version={v}"), True)


def wait(query, seconds: float = 60.0) -> None:
    """Lets a running query work off what is there, then stops it."""
    end = time.time() + seconds
    query.processAllAvailable()
    while query.status["isTriggerActive"] and time.time() < end:
        time.sleep(0.05)
    query.stop()
