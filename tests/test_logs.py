"""Raw logs in splits and as they grow, against reading them whole."""

from __future__ import annotations

import io
import random

import pytest
from pyspark.sql import functions as F

from modelyard.functions.runlog import FINISHED_MARK
from modelyard.operators import runs
from modelyard.session import new_folder
from modelyard.sources.logs import SCHEMA, LogReader, Split, lines_of, lines_of_runs, packed, raw_line_stream, raw_lines, splits_of, whole_lines
from modelyard.streaming.common import run_available


def numbered(data: bytes) -> list[tuple[int, str]]:
    found, at = [], 0
    parts = data.split(b"\n")
    for i, line in enumerate(parts):
        if i < len(parts) - 1 or line:
            found.append((at, line.decode(errors="replace")))
        at += len(line) + 1
    return found


@pytest.mark.parametrize("seed", range(8))
def test_any_split_and_block(seed):
    rng = random.Random(seed)
    data = b"".join(rng.choice([b"a", b"bc", "é日".encode(), b"\n", b"\n\n", b"\r\n", b"\xff", b"x" * 30]) for _ in range(rng.choice([0, 1, 5, 60])))
    for split in (1, 2, 3, 7, 50, 1000):
        for block in (1, 2, 5, 64, 1000):
            got = []
            for part in splits_of("p", 0, len(data), len(data), split):
                for batch in lines_of(io.BytesIO(data), part, block):
                    got += zip(batch.column("seq").to_pylist(), batch.column("line").to_pylist(), strict=True)
            assert got == numbered(data), (data, split, block)


def test_whole_lines():
    data = b"one\ntwo\nthr"
    for block in (1, 3, 100):
        assert whole_lines(io.BytesIO(data), len(data), 0, block) == 8
        assert whole_lines(io.BytesIO(data), 2, 0, block) == 0
        assert whole_lines(io.BytesIO(data), len(data), 8, block) == 8
    assert list(lines_of(io.BytesIO(data), Split("p", 11, 11, 11))) == []


def test_one_file_by_many_tasks(spark, tmp_path):
    """Lines far longer than a split, and splits that end with a line, next to hidden and empty files."""
    rng = random.Random(3)
    texts = {f"run{i}.log": b"".join(b"%d" % j * rng.choice([1, 3, 900]) + b"\n" for j in range(400)) for i in range(2)}
    texts |= {"deep/er/last.log": b"no line feed", "empty.log": b"", ".hidden": b"x\n", "_tmp/part": b"x\n"}
    for name, data in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    lines = raw_lines(spark, str(tmp_path), split_bytes=1000)
    assert lines.rdd.getNumPartitions() > 100
    got = sorted((r["run_id"], r["seq"], r["line"]) for r in lines_of_runs(lines).collect())
    shown = {"run0": texts["run0.log"], "run1": texts["run1.log"], "last": texts["deep/er/last.log"]}
    assert got == sorted((run, seq, line) for run, data in shown.items() for seq, line in numbered(data))
    assert raw_lines(spark, str(tmp_path / "run0.log")).count() == 400


def test_nothing_to_read(spark, tmp_path):
    assert raw_lines(spark, str(tmp_path)).count() == 0


def test_stream_follows_growing_files(spark, tmp_path):
    """Half-written lines wait, new files join, a file that got shorter is read again; the same seqs as one reader of all."""
    logs, sink, checkpoint = tmp_path / "logs", new_folder(spark, "lines"), new_folder(spark, "checkpoint")
    logs.mkdir()

    def go_on():
        run_available(raw_line_stream(spark, str(logs), split_bytes=16), sink, checkpoint)
        return sorted((r["seq"], r["line"]) for r in spark.read.schema(SCHEMA).parquet(sink).collect() if r["path"].endswith("a.log"))

    (logs / "a.log").write_bytes(b"--- Epoch 1/2 ---\nEpoch 1 Trai")
    assert go_on() == [(0, "--- Epoch 1/2 ---")]
    with open(logs / "a.log", "ab") as file:
        file.write(b"ning - Loss: 0.5, Accuracy: 0.25\n" + FINISHED_MARK.encode())
    (logs / "b.log").write_bytes(b"x\ny\n")
    assert go_on() == numbered((logs / "a.log").read_bytes())[:2]
    with open(logs / "a.log", "ab") as file:
        file.write(b"\n")
    whole = numbered((logs / "a.log").read_bytes())
    assert go_on() == whole == go_on()
    read = spark.read.schema(SCHEMA).parquet(sink)
    stream = {r["run_id"]: r for r in runs.final_progress(lines_of_runs(read)).collect()}
    batch = {r["run_id"]: r for r in runs.final_progress(lines_of_runs(raw_lines(spark, str(logs)))).collect()}
    assert stream == batch and batch["a"]["finished"] and read.filter(F.col("path").endswith("b.log")).count() == 2
    (logs / "a.log").write_bytes(b"again\n")
    assert (0, "again") in go_on()


def test_small_splits_share_tasks(tmp_path):
    """As many tasks as the bytes need, however small the splits; every line is read once."""
    text = "".join(f"line {i}\n" for i in range(200_000))
    (tmp_path / "a.log").write_text(text)
    reader = LogReader(f"file://{tmp_path}", 1 << 10)
    parts = reader.partitions()
    assert len(parts) == 1
    assert sum(len(batch) for part in parts for batch in reader.read(part)) == 200_000
    assert [len(p.splits) for p in packed([Split("p", i, i + 10, 90) for i in range(0, 90, 10)], 40)] == [4, 4, 1]
