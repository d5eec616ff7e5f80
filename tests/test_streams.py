"""The registered streams over tables of several part files, in several micro-batches, with late rows."""

from __future__ import annotations

import pathlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from modelyard.operators import runs
from modelyard.operators.lifecycle import MOVES, follow_moves
from modelyard.session import new_folder
from modelyard.streaming.common import line_stream, run_available, table_stream
from modelyard.streaming.lifecycle import follow_stream, track_moves
from modelyard.streaming.linestore import LineStore
from modelyard.streaming.outcomes import TOLD_SCHEMA, follow_outcomes, last_outcomes
from modelyard.streaming.progress import PARSED_SCHEMA, condensed_rows, fold_stream, folded_progress, follow_progress, last_progress

BIG = 1 << 53


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """Every table as a folder of part files."""
    folder = tmp_path_factory.mktemp("tables")
    for name in ("events", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "stream,batch",
    [
        ("progress_stream", "progress_fold"), ("progress_live", "progress_fold"), ("lifecycle_stream", "lifecycle_fold"),
        ("lifecycle_live", "lifecycle_fold"), ("score_stream", "score_rows"), ("outcome_stream", "run_outcome"),
        ("failure_tail_stream", "failure_tail"),
    ],
)
def test_folders_of_part_files(spark, parts, stream, batch):
    queries = driver.queries()
    got, want = (sorted(map(tuple, queries[n](spark, parts).select(sorted(queries[batch](spark, parts).columns)).collect())) for n in (stream, batch))
    assert got == want and len(got) > 0


def test_empty_table_streams_nothing(spark, tmp_path):
    schema = "run_id string, seq bigint, line string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/t.parquet")
    stream = table_stream(spark, str(tmp_path), "t", schema)
    folder = new_folder(spark, "progress")
    fold_stream(stream, folder, new_folder(spark, "checkpoint"))
    assert folded_progress(spark, folder).count() == 0


def log(rng, run):
    lines = []
    for epoch in range(1, rng.randint(2, 6)):
        lines += [
            f"--- Epoch {epoch}/9 ---", f"Epoch {epoch} Training - Loss: {rng.random():.4f}, Accuracy: {rng.random():.4f}",
            "nothing", f"Epoch {epoch} Validation - Loss: {rng.random():.4f}, Accuracy: {rng.random():.4f}",
        ]
    for end in rng.choices(["Training process finished successfully.", "critical error: out of memory"], k=rng.randint(0, 2)):
        lines.insert(rng.randrange(len(lines) + 1), end)
    return [(run, i, line) for i, line in enumerate(lines)]


@pytest.mark.parametrize("seed", [1, 2])
def test_late_lines_fall_into_place(spark, seed):
    rng = random.Random(seed)
    rows = [row for run in range(12) for row in log(rng, f"r{run}")] + [("silent", 3, "nothing"), ("blank", 1, "  ")]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "run_id string, seq bigint, line string")
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("lines", "progress", "checkpoint"))
    for part in range(4):
        spark.createDataFrame(rows[part::4], lines.schema).coalesce(1).write.mode("append").json(folder)
        fold_stream(line_stream(spark, folder), sink, checkpoint)
    want = sorted(map(tuple, runs.final_progress(lines).collect()))
    assert sorted(map(tuple, folded_progress(spark, sink).collect())) == want


def test_state_store_tells_late_rows(spark):
    rows = [("a", i, f"Epoch {i} Validation - Loss: 0.5, Accuracy: 0.{i}") for i in range(1, 9)]
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("lines", "progress", "checkpoint"))
    for part in (rows[4:], rows[:4]):
        spark.createDataFrame(part, "run_id string, seq bigint, line string").coalesce(1).write.mode("append").json(folder)
        run_available(follow_progress(line_stream(spark, folder)), sink, checkpoint)
    told = spark.read.parquet(sink).orderBy(F.desc("late")).first()
    assert (told["late"], told["best_acc"]) == (4, 0.8)
    assert last_progress(spark.read.parquet(sink)).first()["best_acc"] == 0.8

    events = [(BIG + 1, 5, "SCOPING"), (BIG + 1, 3, "SCOPING"), (BIG, 1, "SCOPING"), (None, 1, "SCOPING"), (None, 2, "SPEC_CONFIRMED")]
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("events", "moves", "checkpoint"))
    schema = "p bigint, i bigint, s string"
    for part in (events[:1] + events[2:], events[1:2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(folder)
        run_available(track_moves(spark.readStream.schema(schema).json(folder), "p", "i", "s"), sink, checkpoint)
    got = {(r["p"], r["i"]): (r["accepted"], r["state_after"], r["late"]) for r in spark.read.parquet(sink).collect()}
    assert got == {
        (BIG + 1, 5): (True, "SCOPING", False), (BIG + 1, 3): (None, None, True), (BIG, 1): (True, "SCOPING", False),
        (None, 1): (True, "SCOPING", False), (None, 2): (True, "SPEC_CONFIRMED", False),
    }


def moves_of(rows, start=lambda p: "INIT"):
    at, want = {}, {}
    for p, i, s in sorted(rows, key=lambda r: r[1]):
        state = at.get(p, start(p))
        ok = (state, s) in MOVES
        at[p] = s if ok else state
        want[(p, i)] = (ok, at[p])
    return want


@pytest.mark.parametrize("cap,records", [(10_000, 10_000), (10_000, 7), (20, 10_000), (20, 7)])
def test_moves_keep_ids_and_null_projects(spark, cap, records):
    rng = random.Random(cap + records)
    names = sorted({n for move in MOVES for n in move}) + ["elsewhere", None]
    path = [b for _, b in MOVES]
    rows = [
        (p, 1000 * k + i, rng.choice(path[: 1 + i // 6] + names))
        for k, p in enumerate([None, BIG, BIG + 1, BIG + 2, -BIG - 1, 7])
        for i in range(rng.choice([1, 30, 90]))
    ]
    table = spark.createDataFrame(rows, "p bigint, i bigint, s string").withColumn("other", F.when(F.col("i") % 3 > 0, F.col("p"))).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        begun = F.when(F.col("p") == 7, "ENV_READY").when(F.col("p") == BIG, "nowhere").otherwise("INIT")
        got = follow_moves(table, "p", ["i"], "s", begun, max_rows_per_key=cap).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = moves_of(rows, lambda p: {7: "ENV_READY", BIG: "nowhere"}.get(p, "INIT"))
    assert {(r["p"], r["i"]): (r["accepted"], r["state_after"]) for r in got} == want and len(got) == len(rows)
    assert Counter(r["other"] for r in got) == Counter(p if i % 3 > 0 else None for p, i, _ in rows)


@pytest.mark.parametrize("project", ["bigint", "string"])
def test_followed_batches_with_null_projects(spark, project):
    rows = [(p, i, s) for p in (None, BIG + 1) for i, s in enumerate(["SCOPING", "DONE", "SPEC_CONFIRMED", "SCOPING", "DATA_REQUIRED"])]
    df = spark.createDataFrame(rows, "p bigint, i bigint, s string").withColumn("p", F.col("p").cast(project))
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("events", "moves", "checkpoint"))
    for part in ("i < 2", "i >= 2"):
        df.filter(part).coalesce(1).write.mode("append").json(folder)
        follow_stream(spark.readStream.schema(df.schema).json(folder), "p", "i", "s", sink, checkpoint)
    columns = ["p", "i", "s", "accepted", "state_after"]
    got = Counter(map(tuple, spark.read.parquet(f"{sink}/moves").select(columns).collect()))
    assert got == Counter(map(tuple, follow_moves(df, "p", ["i"], "s").select(columns).collect()))


def ended(rng, run):
    """A log with any number of terminal lines anywhere, and lines that repeat."""
    lines = [rng.choice(["a", "b", "é", "", "Epoch 1/3"]) for _ in range(rng.choice([1, 5, 25, 60]))]
    for end in rng.choices(["Training process finished successfully.", "Training failed: x", "a Critical Error"], k=rng.choice([0, 0, 1, 2])):
        lines[rng.randrange(len(lines))] = end
    return [(run, i, line) for i, line in enumerate(lines)]


@pytest.mark.parametrize("codes_first", [True, False, None])
def test_outcomes_whichever_side_comes_first(spark, codes_first):
    rng = random.Random(11)
    rows = [row for run in range(30) for row in ended(rng, f"r{run}")]
    codes = [(f"r{run}", rng.choice([0, 1, 137])) for run in range(30) if run % 4] + [("unheard of", 1)]
    lines, exits = "run_id string, seq bigint, line string", "run_id string, exit_code int"
    rng.shuffle(rows)
    at, code_at, sink, checkpoint = (new_folder(spark, n) for n in ("lines", "codes", "outcomes", "checkpoint"))
    of_lines = [rows[i::3] for i in range(3)]
    of_codes = [codes, [], []] if codes_first else [codes[:9], codes[9:20], codes[20:]] if codes_first is None else [[], [], codes]
    if codes_first:
        of_lines = [[], rows[::2], rows[1::2]]
    for some_lines, some_codes in zip(of_lines, of_codes, strict=True):
        spark.createDataFrame(some_lines, lines).coalesce(1).write.mode("append").json(at)
        spark.createDataFrame(some_codes, exits).coalesce(1).write.mode("append").json(code_at)
        stream = follow_outcomes(spark.readStream.schema(lines).json(at), spark.readStream.schema(exits).json(code_at))
        run_available(stream, sink, checkpoint)
    told = last_outcomes(spark.read.parquet(sink))
    every, known = spark.createDataFrame(rows, lines), spark.createDataFrame(codes, exits)
    want = runs.run_outcome(runs.run_ends(every), known)
    columns = ["run_id", "outcome", "finished", "failed", "exit_code"]
    assert sorted(map(tuple, told.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)
    got = sorted(map(tuple, told.select("run_id", F.inline("tail")).collect()))
    assert got == sorted(map(tuple, runs.failure_tail(every, want).select("run_id", "seq", "line").collect()))
    assert not told.filter("abandoned").count() and told.filter("not settled").count() > 0


def test_silent_runs_are_told_once_and_forgotten(spark):
    """A run without an end or a code is told as abandoned when nothing has come for a while; one that has ended is not."""
    lines, exits = "run_id string, seq bigint, line string", "run_id string, exit_code int"
    at, code_at, sink, checkpoint = (new_folder(spark, n) for n in ("lines", "codes", "outcomes", "checkpoint"))
    spark.createDataFrame([], exits).coalesce(1).write.json(code_at)
    spark.createDataFrame([("quiet", 1, "a"), ("ended", 1, "Training failed")], lines).coalesce(1).write.json(at)
    stream = follow_outcomes(spark.readStream.schema(lines).json(at), spark.readStream.schema(exits).json(code_at), silence_ms=2000)
    running = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(sink)

    def told_as(run, abandoned, seqs):
        until = time.monotonic() + 60
        while time.monotonic() < until:
            told = [(r["run_id"], r["abandoned"], [t["seq"] for t in r["tail"]]) for r in spark.read.schema(TOLD_SCHEMA).parquet(sink).collect()]
            if (run, abandoned, seqs) in told:
                return told
            time.sleep(0.5)
        raise AssertionError(told)

    try:
        told_as("quiet", True, [1])
        spark.createDataFrame([("quiet", 2, "b")], lines).coalesce(1).write.mode("append").json(at)
        told = told_as("quiet", False, [2])
    finally:
        running.stop()
    assert sum(t[:2] == ("quiet", True) for t in told) == 1 and not any(t[:2] == ("ended", True) for t in told)


def test_a_batch_reads_what_it_needs(spark, monkeypatch):
    """Without an earlier end no batch opens old lines; with one it reads a bucket of a few parts, however many batches there were."""
    opened = []
    read = LineStore._read
    monkeypatch.setattr(LineStore, "_read", lambda self, path: opened.append((self.batch, path)) or read(self, path))
    lines = "run_id string, seq bigint, line string"
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("lines", "progress", "checkpoint"))
    every = []
    for batch in range(18):
        rows = [(f"r{i}", batch * 10 + j, f"Epoch {batch + 1} Validation - Loss: 0.5, Accuracy: 0.{10 + batch}") for i in range(5) for j in (0, 1)]
        if batch == 9:
            rows += [("r1", 35, "Training failed: early"), ("r2", 95, "Training process finished successfully.")]
        every += rows
        spark.createDataFrame(rows, lines).coalesce(1).write.mode("append").json(folder)
        fold_stream(line_stream(spark, folder), sink, checkpoint)
    want = sorted(map(tuple, runs.final_progress(spark.createDataFrame(every, lines)).collect()))
    assert sorted(map(tuple, folded_progress(spark, sink).collect())) == want
    old = {batch: [path for at, path in opened if at == batch and not path.endswith(f"/0-{batch}")] for batch in range(18)}
    merging = {3, 7, 11, 15}
    # r1 and r2 end at or before what later batches bring, which cuts nothing anew; batch 9 alone finds an earlier end.
    assert all(not old[batch] for batch in range(18) if batch not in merging | {9})
    assert 0 < len(old[9]) <= 2 * 3 and all(len(old[batch]) <= 8 for batch in merging)
    assert {p.name for p in pathlib.Path(sink, "states").glob("batch=*")} == {"batch=16", "batch=17"}
    assert len(list(pathlib.Path(sink, "lines", "parts").iterdir())) <= 8
    kept = spark.read.parquet(*[str(p) for p in pathlib.Path(sink, "lines", "parts").iterdir() if p.name.startswith("2-")])
    assert kept.filter("run_id = 'r1' and seq > 35").count() == 0 and kept.filter("run_id = 'r0'").count() == 16 * 3  # two lines and the last one of the batch


def test_a_batch_that_runs_again_finds_the_same_parts(spark):
    """The last commit of a stream is taken away right after parts were merged; the batch replaces its own rows."""
    lines = "run_id string, seq bigint, line string"
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("lines", "progress", "checkpoint"))
    every = []
    for batch in range(8):
        rows = [("a", batch * 2, f"--- Epoch {batch + 1}/9 ---"), ("b", -batch, "Training failed" if batch == 7 else f"--- Epoch {batch + 1}/9 ---")]
        every += rows
        spark.createDataFrame(rows, lines).coalesce(1).write.mode("append").json(folder)
        fold_stream(line_stream(spark, folder), sink, checkpoint)
        if batch in (3, 7):
            commit = pathlib.Path(checkpoint.removeprefix("file:"), "commits", str(batch))
            for path in (commit, commit.with_name(f".{batch}.crc")):
                path.unlink(missing_ok=True)
            fold_stream(line_stream(spark, folder), sink, checkpoint)
    want = sorted(map(tuple, runs.final_progress(spark.createDataFrame(every, lines)).collect()))
    assert sorted(map(tuple, folded_progress(spark, sink).collect())) == want
    assert condensed_rows(spark, sink).count() == 2


def test_line_store_keeps_null_runs_apart(spark):
    folder = new_folder(spark, "store")
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "run_id string, seq bigint")
    for batch in range(5):
        store = LineStore(spark, folder, PARSED_SCHEMA.split(", current")[0], batch, buckets=3)
        assert store.earlier(spark.createDataFrame([("a",)], "run_id string")).count() == batch
        assert store.add(rows).count() == 2
        store.close(spark.createDataFrame([("a", None), (None, None)], "run_id string, end bigint"))
