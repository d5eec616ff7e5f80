"""Run logs, outcomes, retries and times on hand tables; streams against batch."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from modelyard.functions import runlog
from modelyard.operators import metrics, runs
from modelyard.operators.lifecycle import follow_moves
from modelyard.session import ROWS_PER_KEY, new_folder
from modelyard.streaming.common import line_stream, run_available
from modelyard.streaming.lifecycle import follow_stream, track_moves
from modelyard.streaming.progress import FIELDS, condensed_rows, fold_stream, folded_progress, follow_progress, last_progress

GOOD = [
    "--- Epoch 1/3 ---",
    "  Batch 0/938 - Loss: 2.3000",
    "  Batch 100/938 - Loss: 0.1234",
    "Epoch 1 Training - Loss: 0.3512, Accuracy: 0.9012",
    "Epoch 1 Validation - Loss: 0.2000, Accuracy: 0.9400",
    "--- Epoch 2/3 ---",
    "Epoch 2 Training - Loss: nan, Accuracy: 0.9100",
    "",
    "Epoch 2 Validation - Loss: 0.2100, Accuracy: 0.9300",
    "  Batch 5/938 - Loss: 0.1000",
    "Training process finished successfully.",
    "--- Epoch 9/9 ---",
]
FAILED = ["--- Epoch 1/3 ---", "  An unhandled CRITICAL error occurred: no memory ", "Training process finished successfully."]
SILENT = ["starting", "Epoch 4 Training - Loss: 0.5, Accuracy: 0.8"]
LOGS = {"good": GOOD, "failed": FAILED, "silent": SILENT, "crashed": ["oops"], "done": ["bye"]}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(run, i, line) for run, log in LOGS.items() for i, line in enumerate(log)]
    return spark.createDataFrame(rows, "run_id string, seq bigint, line string").repartition(4)


def by_run(df):
    return {r["run_id"]: r.asDict() for r in df.collect()}


def test_final_progress(lines):
    got = by_run(runs.final_progress(lines, F.lit(7)))
    assert got["good"] == dict(
        run_id="good", current_epoch=1, total_epochs=3, train_loss=0.3512, train_acc=0.9012, val_loss=0.21, val_acc=0.93,
        best_acc=0.94, status="Training complete!", finished=True, failed=False, error_message="",
        last_batch_info="Batch 5/938 | Loss: 0.1000",
    )
    assert got["failed"]["error_message"] == "An unhandled CRITICAL error occurred: no memory"
    assert (got["failed"]["failed"], got["failed"]["finished"], got["failed"]["current_epoch"]) == (True, False, 0)
    assert (got["silent"]["current_epoch"], got["silent"]["status"]) == (4, "Epoch 4 — validating...")
    assert (got["crashed"]["total_epochs"], got["crashed"]["status"]) == (7, "Starting...")


@pytest.mark.parametrize("cap", [1000, 3])
def test_progress_by_line(lines, cap):
    got = [r for r in runs.progress_by_line(lines, cap).orderBy("seq").collect() if r["run_id"] == "good"]
    assert [r["seq"] for r in got] == [0, 1, 2, 3, 4, 5, 6 + 2, 9, 10]
    assert [r["current_epoch"] for r in got] == [0, 0, 0, 1, 1, 1, 1, 1, 1]
    assert [r["last_batch_info"][:9] for r in got] == ["", "Batch 0/9", "Batch 100", "Batch 100", "", "", "", "Batch 5/9", "Batch 5/9"]
    assert [r["best_acc"] for r in got] == [0, 0, 0, 0, 0.94, 0.94, 0.94, 0.94, 0.94]


def test_marker_case(spark):
    df = spark.createDataFrame(
        [("a", 1, "training failed"), ("b", 1, "Critical Error"), ("c", 1, "Training failed")],
        "run_id string, seq bigint, line string",
    )
    got = by_run(runs.final_progress(df))
    assert [got[k]["failed"] for k in "abc"] == [False, True, True]


def test_outcomes_and_tail(spark, lines):
    codes = spark.createDataFrame([("good", 1), ("silent", 0), ("crashed", 2)], "run_id string, exit_code int")
    outcomes = runs.run_outcome(runs.final_progress(lines), codes)
    assert {r["run_id"]: r["outcome"] for r in outcomes.collect()} == {
        "good": "success", "failed": "failure", "silent": "success", "crashed": "failure", "done": "failure",
    }
    last = runs.failure_tail(lines, outcomes, 1).collect()
    assert sorted(r["line"] for r in last) == ["bye", "oops"]


def test_tail_and_replay(lines):
    assert sorted(r["seq"] for r in runs.tail(lines, "run_id", "seq", 2).filter("run_id = 'good'").collect()) == [10, 11]
    got = by_run(runs.replayed_progress(lines, 3))
    assert (got["good"]["finished"], got["good"]["best_acc"], got["good"]["total_epochs"]) == (True, 0.0, 0)


def test_tail_drops_rows_before_the_shuffle(lines):
    plan = runs.tail(lines, "run_id", "seq", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_retries(spark):
    attempts = [
        ("first", 1, 0, ""), ("third", 1, 1, "x"), ("third", 2, 1, "x"), ("third", 3, 0, ""),
        ("never", 1, 1, "x"), ("never", 2, 1, "x"), ("never", 3, 1, "x"), ("never", 4, 0, ""),
        ("infra", 1, 1, "ImageNotFound: z"), ("infra", 2, 0, ""), ("late", 1, 1, "x"), ("late", 2, 1, "Docker daemon"),
    ]
    df = spark.createDataFrame(attempts, "run_id string, attempt int, exit_code int, log string")
    got = {r["run_id"]: (r["succeeded"], r["retry_count"], r["attempts_made"], r["error_message"]) for r in runs.retry_outcome(df).collect()}
    lost = "Mock run failed after 3 attempts"
    assert got == {
        "first": (True, 0, 1, None), "third": (True, 2, 3, None), "never": (False, 3, 3, lost),
        "infra": (False, 3, 1, lost), "late": (False, 3, 2, lost),
    }


def test_times_as_text(spark):
    df = spark.createDataFrame([(0.0, 0, 10), (59.9, 1, 10), (3725.0, 5, 10), (100.0, 5, 0), (90.0, 12, 10)], "s double, c int, t int")
    got = df.select(
        runlog.elapsed_text(F.col("s")), runlog.eta_text(F.col("s"), F.col("c"), F.col("t")),
        runlog.progress_fraction(F.col("c"), F.col("t")), runlog.progress_bar(F.col("c"), F.col("t"), 10),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("0m 0s", "calculating...", 0.0, "[" + "░" * 10 + "] 0%"),
        ("0m 59s", "~8m 59s", 0.1, "[█" + "░" * 9 + "] 10%"),
        ("1h 2m 5s", "~1h 2m", 0.5, "[" + "█" * 5 + "░" * 5 + "] 50%"),
        ("1m 40s", "calculating...", None, "[??????????]"),
        ("1m 30s", "~59m 45s", 1.2, "[" + "█" * 10 + "] 120%"),
    ]


def test_elapsed_does_not_shift_with_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql(
            "SELECT 'r' AS run, explode(array(timestamp_ntz'2024-03-09 00:00:00', timestamp_ntz'2024-03-11 00:00:01.5')) AS at"
        )
        assert tuple(runs.elapsed(df, "run", "at").first()) == ("r", 172801.5, "48h 0m 1s")
        zoned = df.select("run", F.col("at").cast("timestamp").alias("at"))
        assert tuple(runs.elapsed(zoned, "run", "at").first()) == ("r", 169201.5, "47h 0m 1s")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_best_epoch(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("z", 1, 0.0)], "run string, epoch int, acc double")
    assert [tuple(r) for r in metrics.best_epoch(df, ["run"], "acc", ["epoch"]).collect()] == [("a", 2, 0.9)]


def test_stream_in_two_instalments_equals_batch(spark, lines):
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("lines", "progress", "checkpoint"))
    for part in ("seq < 4", "seq >= 4"):
        lines.filter(part).coalesce(1).write.mode("append").json(folder)
        run_available(follow_progress(line_stream(spark, folder), 7), sink, checkpoint)
    streamed = by_run(last_progress(spark.read.parquet(sink)))
    batch = by_run(runs.final_progress(lines, F.lit(7)).select("run_id", *FIELDS))
    # Runs that say nothing leave no row in the stream.
    assert streamed == {k: v for k, v in batch.items() if k not in ("crashed", "done")}
    assert spark.read.parquet(sink).filter("run_id = 'good'").count() == 2


def forget_last_commit(checkpoint):
    """As if the driver had gone after the work and before the commit of the last batch."""
    commits = Path(checkpoint) / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()
    for crc in commits.glob(f".{last}.crc"):
        crc.unlink()


def test_folded_batches_equal_batch(spark, lines):
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("lines", "progress", "checkpoint"))
    for part in ("seq < 2", "seq >= 2 and seq < 6", "seq >= 6"):
        lines.filter(part).coalesce(1).write.mode("append").json(folder)
        fold_stream(line_stream(spark, folder), sink, checkpoint)
    want = by_run(runs.final_progress(lines, F.lit(7)))
    assert by_run(folded_progress(spark, sink, F.lit(7))) == want
    forget_last_commit(checkpoint)
    fold_stream(line_stream(spark, folder), sink, checkpoint)
    assert by_run(folded_progress(spark, sink, F.lit(7))) == want
    # The failed run ended in the first batch, so the next ones have no row of it.
    assert condensed_rows(spark, sink).filter("run_id = 'failed'").count() == 1


@pytest.mark.parametrize("cap", [1000, 2])
def test_followed_batches_keep_their_state(spark, cap):
    spark.conf.set(ROWS_PER_KEY, cap)
    moves = ["SCOPING", "DONE", "SPEC_CONFIRMED", "SCOPING", "DATA_REQUIRED", "DATA_VALIDATED", "ENV_BUILDING"]
    rows = [("p", i, s) for i, s in enumerate(moves)] + [("q", 0, "DATA_REQUIRED"), ("q", 5, "SCOPING")]
    df = spark.createDataFrame(rows, "p string, i bigint, s string")
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("events", "moves", "checkpoint"))
    try:
        for part in ("i < 3", "i >= 3"):
            df.filter(part).coalesce(1).write.mode("append").json(folder)
            follow_stream(spark.readStream.schema(df.schema).json(folder), "p", "i", "s", sink, checkpoint)
        forget_last_commit(checkpoint)
        follow_stream(spark.readStream.schema(df.schema).json(folder), "p", "i", "s", sink, checkpoint)
        got = {(r["p"], r["i"]): (r["accepted"], r["state_after"]) for r in spark.read.parquet(f"{sink}/moves").collect()}
        batch = follow_moves(df, "p", ["i"], "s")
        assert got == {(r["p"], r["i"]): (r["accepted"], r["state_after"]) for r in batch.collect()}
        assert got[("p", 6)] == (True, "ENV_BUILDING") and got[("q", 5)] == (True, "SCOPING")
        assert len(got) == spark.read.parquet(f"{sink}/moves").count() == len(rows)
    finally:
        spark.conf.unset(ROWS_PER_KEY)


def test_lifecycle_stream_keeps_its_state(spark):
    moves = ["SCOPING", "DONE", "SPEC_CONFIRMED", "SCOPING", "DATA_REQUIRED", "DATA_VALIDATED"]
    rows = [("p", i, s) for i, s in enumerate(moves)] + [("q", 0, "DATA_REQUIRED")]
    df = spark.createDataFrame(rows, "p string, i bigint, s string")
    folder, sink, checkpoint = (new_folder(spark, n) for n in ("events", "moves", "checkpoint"))
    for part in ("i < 3", "i >= 3"):
        df.filter(part).coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema(df.schema).json(folder)
        run_available(track_moves(stream, "p", "i", "s"), sink, checkpoint)
    got = [tuple(r)[:5] for r in spark.read.parquet(sink).orderBy("p", "i").collect()]
    assert got == [
        ("p", 0, "SCOPING", True, "SCOPING"), ("p", 1, "DONE", False, "SCOPING"),
        ("p", 2, "SPEC_CONFIRMED", True, "SPEC_CONFIRMED"), ("p", 3, "SCOPING", False, "SPEC_CONFIRMED"),
        ("p", 4, "DATA_REQUIRED", True, "DATA_REQUIRED"), ("p", 5, "DATA_VALIDATED", True, "DATA_VALIDATED"),
        ("q", 0, "DATA_REQUIRED", False, "INIT"),
    ]
