"""Listing a dataset directory without reading what is in the files."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelyard.functions.text import file_extension, file_name, parent_dir
from modelyard.session import pinned

ROWS_PER_BATCH = 10_000


def qualified(spark: SparkSession, root: str) -> str:
    """A path as a URI, scheme and host included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return uri if "://" in uri else uri.replace(":", "://", 1)


#: The driver lists so many folders and entries itself; small trees need no job.
DRIVER_FOLDERS = 64
DRIVER_ENTRIES = 20_000
#: The entries of a local folder are looked up in pages of so many names, by different tasks.
PAGE = 10_000
FOUND_SCHEMA = "kind string, path string, names array<string>, length bigint, modified timestamp"
FILE, FOLDER, NAMES = "file", "folder", "names"


def _described(found: list) -> pa.RecordBatch:
    """Files and folders as the file system describes them."""
    some = [f for f in found if f.type in (pafs.FileType.File, pafs.FileType.Directory)]
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.array([FILE if f.type == pafs.FileType.File else FOLDER for f in some], pa.string()),
            "path": pa.array([f.path for f in some], pa.string()),
            "names": pa.nulls(len(some), pa.list_(pa.string())),
            "length": pa.array([f.size for f in some], pa.int64()),
            "modified": pa.array([f.mtime_ns and f.mtime_ns // 1000 for f in some], pa.timestamp("us", "UTC")),
        }
    )


def _pending(kind: str, rows: list[tuple[str, list[str] | None]]) -> pa.RecordBatch:
    """Folders to be listed, or pages of names to be looked up."""
    paths, names = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.array([kind] * len(rows), pa.string()),
            "path": pa.array(paths, pa.string()),
            "names": pa.array(names, pa.list_(pa.string())),
            "length": pa.nulls(len(rows), pa.int64()),
            "modified": pa.nulls(len(rows), pa.timestamp("us", "UTC")),
        }
    )


def _look(files, folder: str, names: list[str] | None, page: int) -> Iterator[pa.RecordBatch]:
    """What is in a folder, or what some names of a folder are; nothing is opened.

    A local folder is read name by name; folders in it are told as such, files are looked up here as far as one page goes, and the
    names of further pages are handed on. Other file systems describe what they list. Links to folders are not followed.
    """
    if names is not None:
        yield _described(files.get_file_info([f"{folder}/{name}" for name in names]))
    elif isinstance(files, pafs.LocalFileSystem):
        own, held, folders = True, [], []
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    folders.append((entry.path, None))
                elif not entry.is_symlink() or entry.is_file():
                    held.append(entry.name)
                if len(folders) == page:
                    yield _pending(FOLDER, folders)
                    folders = []
                if len(held) == page:
                    yield from _look(files, folder, held, page) if own else [_pending(NAMES, [(folder, held)])]
                    own, held = False, []
        if folders:
            yield _pending(FOLDER, folders)
        if held:
            yield from _look(files, folder, held, page) if own else [_pending(NAMES, [(folder, held)])]
    else:
        found = files.get_file_info(pafs.FileSelector(folder))
        for first in range(0, len(found), ROWS_PER_BATCH):
            yield _described(found[first : first + ROWS_PER_BATCH])


def _listed(frontier: DataFrame, uri: str, page: int) -> DataFrame:
    """What is in every folder and behind every page of names, on the file system of `uri`."""

    def look(batches):
        files, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder, names in zip(batch.column("path").to_pylist(), batch.column("names").to_pylist(), strict=True):
                yield from _look(files, folder, names, page)

    return frontier.select("path", "names").mapInArrow(look, FOUND_SCHEMA)


def _listed_here(uri: str, top: str, page: int) -> tuple[list[pa.RecordBatch], list[tuple[str, list[str] | None]]]:
    """The files found by listing a few folders on the driver, and what is left to be listed."""
    files, _ = pafs.FileSystem.from_uri(uri)
    found, entries, frontier = [], 0, deque([(top, None)])
    for _ in range(DRIVER_FOLDERS):
        if not frontier or entries > DRIVER_ENTRIES:
            break
        for batch in _look(files, *frontier.popleft(), page):
            entries += batch.num_rows
            rows = pa.Table.from_batches([batch])
            found.append(rows.filter(pc.equal(rows["kind"], FILE)))
            rest = rows.filter(pc.not_equal(rows["kind"], FILE))
            frontier.extend(zip(rest["path"].to_pylist(), rest["names"].to_pylist(), strict=True))
    return found, list(frontier)


def list_files(spark: SparkSession, root: str, page: int = PAGE) -> DataFrame:
    """Every regular file below `root`, hidden ones too: `(relative, name, ext, dir, length, modified)`.

    The driver lists the first few folders. What is left is listed by executors, round by round: each round takes the folders that the
    one before has found, dealt out anew, until there are none. A large folder is handed on in pages of names. The file
    system must be one that Arrow reads (local or mounted, HDFS, S3, GCS).
    """
    uri = qualified(spark, root)
    top = pafs.FileSystem.from_uri(uri)[1].rstrip("/")
    here, left = _listed_here(uri, top or "/", page)
    found = [spark.createDataFrame(pa.concat_tables(here), FOUND_SCHEMA)] if here else [spark.createDataFrame([], FOUND_SCHEMA)]
    frontier, n = spark.createDataFrame(left, "path string, names array<string>"), len(left)
    while n:
        # A fixed number of partitions, as the few bytes of many names would be put together in one task.
        dealt = frontier.repartition(min(n, 8 * spark.sparkContext.defaultParallelism), "path", "names")
        listed = pinned(_listed(dealt, uri, page))
        found.append(listed.filter(F.col("kind") == FILE))
        frontier = listed.filter(F.col("kind") != FILE)
        n = frontier.count()
    every = reduce(DataFrame.unionByName, found).select(
        F.substring("path", len(top) + 2, 1 << 30).alias("relative"), "length", "modified"
    )
    return every.select(
        "relative",
        file_name(F.col("relative")).alias("name"),
        file_extension(F.col("relative")).alias("ext"),
        parent_dir(F.col("relative")).alias("dir"),
        "length",
        "modified",
    )


def visible(files: DataFrame) -> DataFrame:
    """Without names that start with a dot."""
    return files.filter(~F.startswith("name", F.lit(".")))
