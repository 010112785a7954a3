"""Trees of files, listed, read, removed and moved by tasks: the driver sees no file's name."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize


def opened(uri: str):
    """(file system, path) of a URI or of a plain path."""
    import os

    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", uri))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, size, modified) of all files below root, hidden and underscored ones too; file is the path below root, modified in seconds.

    Folders are listed level by level, each by a task that has it; a level is written
    before the next one. A root that is not there has no file.
    """
    c = F.col
    uri = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, base = opened(uri)
        for b in batches:
            names, folders, sizes, times = [], [], [], []
            for folder in b.column("file").to_pylist():
                for info in place.get_file_info(fs.FileSelector(posixpath.join(base, folder), allow_not_found=True)):
                    names.append(posixpath.join(folder, info.base_name))
                    folders.append(info.type == fs.FileType.Directory)
                    sizes.append(info.size or 0)
                    times.append(info.mtime_ns / 1e9 if info.mtime_ns else None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(times, pa.float64())], names=["file", "folder", "size", "modified"])

    level = spark.createDataFrame([("",)], "file string")
    found: DataFrame | None = None
    while True:
        inside = materialize(level.mapInArrow(run, "file string, folder boolean, size long, modified double"), "folder-level")
        files = inside.where("NOT folder").select("file", "size", "modified")
        found = files if found is None else found.unionByName(files)
        level = inside.where("folder").select("file")
        if level.isEmpty():
            return found
        level = level.repartition(c("file"))  # a folder's subfolders are dealt over tasks


def read_tree(files: DataFrame, root: str, file: str = "file") -> DataFrame:
    """files with a column content: the text of each, read by tasks; bytes that are no UTF-8 are replaced."""
    uri = root.rstrip("/")
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = opened(uri)
        for b in batches:
            for i, name in enumerate(b.column(names.index(file)).to_pylist()):  # one at a time: a batch of files may be large
                with place.open_input_stream(posixpath.join(base, name)) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([*[x.slice(i, 1) for x in b.columns], pa.array([text])], names=[*names, "content"])

    return files.repartition(F.col(file)).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", content string")


def remove_files(files: DataFrame, root: str, file: str = "file") -> int:
    """Removes files below root; those that are gone already are none. The number of rows."""
    uri = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = opened(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                try:
                    place.delete_file(posixpath.join(base, name))
                except FileNotFoundError:
                    pass  # an earlier attempt of this task
            yield b

    return files.select(file).mapInArrow(run, f"`{file}` string").count()
