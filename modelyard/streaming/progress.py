"""Live progress of training runs from a stream of log lines.

`fold_stream` folds each micro-batch with aggregates that combine before the shuffle, and keeps
one row per run with the place of every value, so that late lines fall into place; a run may fill
a whole batch of any size. `follow_progress` keeps the state in the state store and answers sooner, for batches
whose runs each fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modelyard.functions.runlog import LINE_FIELDS
from modelyard.functions.text import strip
from modelyard.operators.runs import fold_progress, informative, parse_lines
from modelyard.session import is_folder, pinned
from modelyard.streaming.common import batches_of, forget_batch
from modelyard.streaming.linestore import LineStore

COUNTS = ("current_epoch", "total_epochs")
NUMBERS = ("train_loss", "train_acc", "val_loss", "val_acc")
TEXTS = ("status", "error_message", "last_batch_info")
FIELDS = (*COUNTS, *NUMBERS, "best_acc", *TEXTS, "finished", "failed")
STATE_SCHEMA = (
    "last_seq bigint, current_epoch bigint, total_epochs bigint, train_loss double, train_acc double, "
    "val_loss double, val_acc double, best_acc double, status string, error_message string, "
    "last_batch_info string, finished boolean, failed boolean, late bigint"
)


def _take_in(now: dict, rows: pd.DataFrame) -> dict:
    """Progress after some more lines in order."""
    ends = rows["finished"] | rows["failed"]
    if ends.any():
        rows = rows.loc[: ends.idxmax()]
    after = dict(now)
    for name in (*COUNTS, *NUMBERS, *TEXTS):
        said = rows[name].dropna()
        if len(said):
            after[name] = int(said.iloc[-1]) if name in COUNTS else said.iloc[-1]
    after["best_acc"] = max(now["best_acc"], float(rows["val_acc"].max())) if rows["val_acc"].notna().any() else now["best_acc"]
    after["finished"] = bool(rows["finished"].any())
    after["failed"] = bool(rows["failed"].any())
    after["last_seq"] = int(rows["seq"].iloc[-1])
    return {k: float(v) if k in NUMBERS else v for k, v in after.items()}


def follow_progress(lines: DataFrame, total_epochs: int = 0) -> DataFrame:
    """One row per run and micro-batch with the progress reached.

    Lines are parsed and thinned out before the shuffle; what a run sends in one micro-batch
    is bounded by the byte limit of the source. What follows a terminal line is left out. Lines
    at or before the last one seen come too late for the state store: they change nothing, and
    `late` counts them for every run (`fold_stream` takes them in).
    """
    start = {
        "last_seq": -(1 << 62), "current_epoch": 0, "total_epochs": total_epochs,
        "train_loss": 0.0, "train_acc": 0.0, "val_loss": 0.0, "val_acc": 0.0, "best_acc": 0.0,
        "status": "Starting...", "error_message": "", "last_batch_info": "", "finished": False, "failed": False,
        "late": 0,
    }

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(start, state.get)) if state.exists else dict(start)
        came = pd.concat(list(batches))
        rows = came[came["seq"] > now["last_seq"]].sort_values("seq", ignore_index=True)
        late = len(came) - len(rows)
        if now["finished"] or now["failed"]:
            rows = rows.iloc[:0]
        if len(rows) == 0 and late == 0:
            return
        now = _take_in(now, rows) if len(rows) else dict(now)
        now["late"] += late
        state.update(tuple(now[k] for k in start))
        yield pd.DataFrame([{"run_id": key[0], **now}])

    return (
        informative(parse_lines(lines))
        .groupBy("run_id")
        .applyInPandasWithState(
            fold, f"run_id string, {STATE_SCHEMA}", STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
        )
    )


def last_progress(emitted: DataFrame) -> DataFrame:
    """The newest row of every run out of what the stream has written."""
    return (
        emitted.groupBy("run_id")
        .agg(F.max_by(F.struct(*FIELDS), F.struct("last_seq", "late")).alias("_last"))
        .select("run_id", "_last.*")
    )


# ---- folding micro-batches with the batch aggregates

PARSED_SCHEMA = (
    "run_id string, seq bigint, current_epoch bigint, total_epochs bigint, train_loss double, train_acc double, val_loss double, "
    "val_acc double, best_acc double, status string, finished boolean, failed boolean, error_message string, "
    "last_batch_info string"
)
LATEST = tuple(n for n in LINE_FIELDS if n not in ("best_acc", "finished", "failed"))


def _placed(parsed: DataFrame) -> DataFrame:
    """Parsed lines with the place of every field that they say something about."""
    return parsed.withColumns({f"{n}_at": F.when(F.col(n).isNotNull(), F.col("seq")) for n in LATEST})


def _merged(placed: DataFrame) -> DataFrame:
    """One row per run: each field as its latest line has it, and where that line is."""
    return placed.groupBy("run_id").agg(
        F.max("seq").alias("seq"),
        F.max("best_acc").alias("best_acc"),
        F.bool_or("finished").alias("finished"),
        F.bool_or("failed").alias("failed"),
        *[F.max_by(n, f"{n}_at").alias(n) for n in LATEST],
        *[F.max(f"{n}_at").alias(f"{n}_at") for n in LATEST],
    )


def _state_schema() -> str:
    return PARSED_SCHEMA + "".join(f", {n}_at bigint" for n in LATEST)


def condensed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every run after the last batch."""
    newest = max(batches_of(spark, f"{folder}/states"))
    return spark.read.schema(_state_schema()).parquet(f"{folder}/states/batch={newest}")


def fold_stream(lines: DataFrame, folder: str, checkpoint: str) -> None:
    """Fold the lines that have arrived into `folder` and stop; lines may come late and in any order.

    A run ends at its first terminal line. `folder`/states holds one row per run after the last batches, and a batch reads
    that of the batch before. The lines that say something are kept in a store of lines; a batch reads old ones only
    of runs whose end turns out to be earlier than lines already folded. A batch that is run again replaces its own rows.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = LineStore(spark, f"{folder}/lines", PARSED_SCHEMA, batch_id)
        # A run that says nothing of note is known by its last line.
        silent = batch.filter(strip(F.col("line")) != "").groupBy("run_id").agg(F.max("seq").alias("seq"))
        silent = silent.withColumns({"finished": F.lit(False), "failed": F.lit(False)})
        said = informative(parse_lines(batch)).unionByName(silent, allowMissingColumns=True)
        mine = store.add(said.select("run_id", "seq", *LINE_FIELDS))
        before = spark.read.schema(_state_schema()).parquet(f"{folder}/states/batch={batch_id - 1}")
        last = F.when(F.col("finished") | F.col("failed"), F.col("seq"))
        ends = before.select("run_id", last.alias("end"), F.col("seq").alias("seen")).unionByName(
            mine.select("run_id", last.alias("end"), F.lit(None).cast("bigint").alias("seen"))
        )
        ends = ends.groupBy("run_id").agg(F.min("end").alias("end"), F.max("seen").alias("seen"))
        # One row per run of this batch and the batches before.
        ends = pinned(ends.withColumn("cut", F.coalesce(F.col("seen") > F.col("end"), F.lit(False))))
        cut = ends.filter("cut").select("run_id")
        rows = before.join(cut, "run_id", "left_anti").unionByName(_placed(mine.unionByName(store.earlier(cut))))
        within = rows.join(ends.select("run_id", "end"), "run_id").filter(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
        _merged(within.drop("end")).write.mode("overwrite").parquet(f"{folder}/states/batch={batch_id}")
        store.close(ends)
        forget_batch(spark, f"{folder}/states", batch_id - 2)

    spark = lines.sparkSession
    if not is_folder(spark, f"{folder}/states"):
        spark.createDataFrame([], _state_schema()).write.mode("overwrite").parquet(f"{folder}/states/batch=-1")
    (
        lines.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def folded_progress(spark: SparkSession, folder: str, total_epochs: Column | None = None) -> DataFrame:
    """Progress of every run as far as the stream has come."""
    return fold_progress(condensed_rows(spark, folder).select("run_id", "seq", *LINE_FIELDS), total_epochs)
