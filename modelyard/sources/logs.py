"""Raw log files as tables: every line with the byte at which it begins, however the files are split.

A file is cut into splits of bytes. A split has the lines that begin in it, wherever in a line it begins itself, so that the lines
and their offsets are those that one reader of the whole file would give. The offset is the line's `seq`: it grows along the
file, it is known without counting the lines before, and it does not change when the file grows.

The stream follows growing files. Its offset is how far every file has been read, always to the end of a line: a line
that is still being written waits for its line feed, while the batch reader gives the unfinished last line, too. A file
that got shorter is read from its beginning again. The offset has an entry per file, so that files of finished
runs should leave the folder some day.

File systems are those that Arrow reads (local or mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from modelyard.functions.text import file_name
from modelyard.sources.files import qualified

FORMAT = "raw_log"
SCHEMA = "path string, seq bigint, line string"
SPLIT_BYTES = 128 << 20
BLOCK = 4 << 20
#: Splits smaller than this are read several to a task.
TASK_BYTES = 8 << 20
LINE_FEED = 0x0A


@dataclass
class Split(InputPartition):
    """The lines of a file that begin in [start, end); a file is not read beyond `size`."""

    path: str
    start: int
    end: int
    size: int


@dataclass
class Splits(InputPartition):
    """Splits that one task reads, one after the other."""

    splits: list[Split]


def splits_of(path: str, start: int, end: int, size: int, split_bytes: int) -> list[Split]:
    return [Split(path, at, min(at + split_bytes, end), size) for at in range(start, end, split_bytes)]


def packed(splits: list[Split], least: int = TASK_BYTES) -> list[Splits]:
    """The splits in their order, so many together that they have `least` bytes, so that small splits do not make as many tasks."""
    found, held = [], 0
    for split in splits:
        if not found or held >= least:
            found.append(Splits([]))
            held = 0
        found[-1].splits.append(split)
        held += split.end - split.start
    return found


def _as_batch(path: str, data: bytes, first: int, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Lines data[start:end], one behind the other with a line feed between; the data begins at byte `first` of the file.

    Bytes that are no UTF-8 are replaced.
    """
    n, own = len(starts), data[starts[0] : ends[-1]]
    try:
        own.decode()
        # Without the line feeds, the end of a line is the beginning of the next.
        offsets = np.append(starts - starts[0], ends[-1] + 1 - starts[0]) - np.arange(n + 1)
        lines = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own.replace(b"\n", b"")))
    except UnicodeDecodeError:
        lines = pa.array([data[a:b].decode(errors="replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(starts + first, pa.int64()), lines], names=["path", "seq", "line"])


def lines_of(file, split: Split, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The lines of a split as batches; `file` is open for reading and can seek."""
    at = split.start
    if at:
        # The byte before tells whether a line begins here; if none does, the first line begins behind the next line feed.
        at = split.start - 1
        file.seek(at)
        while True:
            data = file.read(min(block, split.size - at))
            if not data:
                return
            place = data.find(b"\n")
            at += place + 1 if place >= 0 else len(data)
            if place >= 0:
                break
    file.seek(at)
    held, ahead = [], at  # what a line that goes on has brought so far, and how far the file has been read
    while at < split.end:
        data = file.read(min(block, split.size - ahead))
        ahead += len(data)
        if not data:
            if held:  # the last line of the file has no line feed
                whole = b"".join(held)
                yield _as_batch(split.path, whole, at, np.array([0]), np.array([len(whole)]))
            return
        if b"\n" not in data:
            held.append(data)
            continue
        data = b"".join([*held, data])
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == LINE_FEED)
        starts = np.concatenate([[0], ends[:-1] + 1])
        own = int((starts + at < split.end).sum())
        yield _as_batch(split.path, data, at, starts[:own], ends[:own])
        held = [data[ends[-1] + 1 :]] if ends[-1] + 1 < len(data) else []
        at += int(ends[-1]) + 1


def _read(uri: str, split: Split) -> Iterator[pa.RecordBatch]:
    files, _ = pafs.FileSystem.from_uri(uri)
    with files.open_input_file(split.path) as file:
        yield from lines_of(file, split)


def _listed(uri: str) -> list[tuple[str, int]]:
    """Path and size of every file below the folder, or of the one file."""
    files, root = pafs.FileSystem.from_uri(uri)
    own = files.get_file_info(root)
    if own.type == pafs.FileType.File:
        return [(own.path, own.size)]
    found = files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = ("_", ".")
    kept = [f for f in found if f.type == pafs.FileType.File and not any(p.startswith(hidden) for p in f.path[len(root) :].split("/") if p)]
    return sorted((f.path, f.size) for f in kept)


def whole_lines(file, size: int, known: int, block: int = 1 << 16) -> int:
    """The end of the last line that has its line feed, looked for backwards as far as `known`."""
    until = size
    while until > known:
        first = max(known, until - block)
        file.seek(first)
        place = file.read(until - first).rfind(b"\n")
        if place >= 0:
            return first + place + 1
        until = first
    return known


class LogReader(DataSourceReader):
    def __init__(self, uri: str, split_bytes: int):
        self.uri, self.split_bytes = uri, split_bytes

    def partitions(self) -> list[Splits]:
        found = [s for path, size in _listed(self.uri) for s in splits_of(path, 0, size, size, self.split_bytes)]
        return packed(found) or [Splits([])]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        for split in partition.splits:
            yield from _read(self.uri, split)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are {path: bytes read}; what has been found of a file is looked at again only when its size changes."""

    def __init__(self, uri: str, split_bytes: int):
        self.uri, self.split_bytes, self.seen = uri, split_bytes, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, _ = pafs.FileSystem.from_uri(self.uri)
        now = {}
        for path, size in _listed(self.uri):
            before, end = self.seen.get(path, (0, 0))
            if size != before:
                with files.open_input_file(path) as file:
                    end = whole_lines(file, size, end if size > before else 0)
                self.seen[path] = (size, end)
            now[path] = end
        return now

    def partitions(self, start: dict, end: dict) -> list[Split]:
        found = []
        for path, until in sorted(end.items()):
            first = start.get(path, 0)
            found += splits_of(path, first if first <= until else 0, until, until, self.split_bytes)
        return found or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _read(self.uri, partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """Options: `path`, a folder or a file, and `splitBytes`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema) -> LogReader:
        return LogReader(*self._options())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(*self._options())


def raw_lines(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, seq (the byte at which the line begins), line: all lines of the files in a folder."""
    spark.dataSource.register(LogSource)
    return spark.read.format(FORMAT).option("splitBytes", split_bytes).load(qualified(spark, folder))


def raw_line_stream(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same lines as a stream that follows growing files."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format(FORMAT).option("splitBytes", split_bytes).load(qualified(spark, folder))


def lines_of_runs(lines: DataFrame) -> DataFrame:
    """run_id (the file name without its extension), seq, line, as the operators over runs take them."""
    return lines.select(F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "").alias("run_id"), "seq", "line")
