"""The current state of every project without reading all records again: a snapshot, and the records that came since.

Records are appended as JSON, each time into a folder of its own. A snapshot is a columnar table with the newest record of each
project; its mark, which is there as a whole or not at all, names the folders that it has taken in. The current state is
that of the snapshot with the last mark and of the folders that the mark does not name, so that records that arrive during a
compaction, and compactions that were cut off, change nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelyard.session import delete_folder, names_in, read_whole, write_whole
from modelyard.sources.tables import STATE_SCHEMA

FIELDS = ("project_id", "state", "at", "seq", "spec")


def append(states: DataFrame, path: str) -> None:
    """Add records; a folder that was not written to its end is not read."""
    states.select(*FIELDS).write.json(f"{path}/records/{time.time_ns():020d}-{uuid.uuid4().hex}")


def _complete(spark: SparkSession, path: str) -> list[str]:
    return [name for name in names_in(spark, f"{path}/records") if "_SUCCESS" in names_in(spark, f"{path}/records/{name}")]


def _last_mark(spark: SparkSession, path: str) -> dict:
    """The mark of the last snapshot: its folder and the folders of records that it holds, empty without one."""
    marks = [name for name in names_in(spark, f"{path}/marks") if not name.startswith(".")]
    return json.loads(read_whole(spark, f"{path}/marks/{marks[-1]}")) if marks else {"number": 0, "snapshot": None, "taken": []}


def _newest(records: DataFrame) -> DataFrame:
    """The newest record of each project; partial maxima are taken before the shuffle."""
    rest = F.struct(*[c for c in FIELDS if c != "project_id"])
    return records.groupBy("project_id").agg(F.max_by(rest, F.struct("at", "seq", "state")).alias("newest")).select("project_id", "newest.*")


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records that are still there, for the history of a project."""
    paths = [f"{path}/records/{name}" for name in _complete(spark, path)]
    return spark.read.schema(STATE_SCHEMA).json(paths) if paths else spark.createDataFrame([], STATE_SCHEMA)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest record of every project: those of the last snapshot and of the folders written since."""
    mark = _last_mark(spark, path)
    fresh = [f"{path}/records/{name}" for name in _complete(spark, path) if name not in set(mark["taken"])]
    parts = spark.read.schema(STATE_SCHEMA).json(fresh) if fresh else spark.createDataFrame([], STATE_SCHEMA)
    if mark["snapshot"]:
        parts = parts.unionByName(spark.read.schema(STATE_SCHEMA).parquet(f"{path}/snapshots/{mark['snapshot']}"))
    return _newest(parts.select(*FIELDS))


def compact(spark: SparkSession, path: str, keep_records: bool = True) -> None:
    """Write a new snapshot and its mark; then the snapshots before the last one go, and, unless kept, the records in that one.

    One compaction runs at a time; readers may run beside it. They have found their snapshot before it is deleted, as two
    are kept.
    """
    mark, names = _last_mark(spark, path), _complete(spark, path)
    fresh = [name for name in names if name not in set(mark["taken"])]
    if not fresh:
        return
    snapshot = uuid.uuid4().hex
    current(spark, path).write.parquet(f"{path}/snapshots/{snapshot}")
    number = mark["number"] + 1
    # What `current` may have seen beyond the list is read again next time: taking a record in twice changes nothing.
    now = {"number": number, "snapshot": snapshot, "taken": [n for n in names if n in set(mark["taken"])] + fresh, "before": mark["snapshot"]}
    write_whole(spark, f"{path}/marks/{number:020d}", json.dumps(now))
    for name in names_in(spark, f"{path}/snapshots"):
        if name not in (snapshot, mark["snapshot"]):
            delete_folder(spark, f"{path}/snapshots/{name}")
    for name in mark["taken"] if not keep_records else []:
        delete_folder(spark, f"{path}/records/{name}")
