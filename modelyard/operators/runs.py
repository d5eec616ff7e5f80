"""Training runs from their logs: progress, tails, outcomes, retries, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelyard.functions import runlog
from modelyard.functions.text import INFRASTRUCTURE_MARKS, contains_any, strip
from modelyard.operators.ordered import Running, running

# Attempts of a dry run, lines replayed and lines shown after a failure.
MAX_ATTEMPTS = 3
REPLAY_LINES = 50
FAILURE_LINES = 20


def parse_lines(lines: DataFrame) -> DataFrame:
    """`(run_id, seq)` with what each non-blank line says about every progress field."""
    text = lines.select("run_id", "seq", strip(F.col("line")).alias("line")).filter("line <> ''")
    # The one-element inline keeps later filters from repeating the patterns.
    parts = text.select("run_id", "seq", "line", F.inline(F.array(runlog.line_parts(F.col("line")))))
    return parts.select("run_id", "seq", *[c.alias(n) for n, c in runlog.fields_of().items()])


def informative(parsed: DataFrame) -> DataFrame:
    """Lines that change some field; all others can go before any shuffle."""
    said = F.col("finished") | F.col("failed") | F.col("status").isNotNull() | F.col("last_batch_info").isNotNull()
    return parsed.filter(said)


def run_ends(lines: DataFrame) -> DataFrame:
    """First terminal line of every run: `(run_id, end, finished, failed)`, `end` null without one.

    Plain substring tests on the line are all it takes.
    """
    line = F.col("line")
    marked = lines.select(
        "run_id", "seq", runlog.is_finished(line).alias("finished"), runlog.is_failed(line).alias("failed")
    )
    at = F.when(F.col("finished") | F.col("failed"), F.col("seq"))
    return marked.groupBy("run_id").agg(
        F.min(at).alias("end"),
        F.coalesce(F.min_by("finished", at), F.lit(False)).alias("finished"),
        F.coalesce(F.min_by("failed", at), F.lit(False)).alias("failed"),
    )


def _ends_a_run() -> Column:
    return runlog.is_finished(F.col("line")) | runlog.is_failed(F.col("line"))


def until_terminal(lines: DataFrame) -> DataFrame:
    """Drop what follows the first line that ends a run; only lines that end one are aggregated."""
    ends = lines.filter(_ends_a_run()).groupBy("run_id").agg(F.min("seq").alias("end"))
    return (
        lines.join(ends, "run_id", "left")
        .filter(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
        .drop("end")
    )


def condense(parsed: DataFrame) -> DataFrame:
    """One row per run that says what all its lines said: the newest of each field, the best accuracy.

    It has the columns of a parsed line, so condensed rows of later lines can be condensed
    again. Every field is an aggregate that combines before the shuffle: a run of any length
    reaches the reducer as one partial row per task.
    """

    def latest(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    last = [n for n in runlog.LINE_FIELDS if n not in ("best_acc", "finished", "failed")]
    return parsed.groupBy("run_id").agg(
        F.max("seq").alias("seq"),
        F.max("best_acc").alias("best_acc"),
        F.bool_or("finished").alias("finished"),
        F.bool_or("failed").alias("failed"),
        *[latest(n) for n in last],
    )


def fold_progress(parsed: DataFrame, total_epochs: Column | None = None) -> DataFrame:
    """State of each run after its last line, with a start value for what was never said."""
    start = {
        "total_epochs": F.lit(0) if total_epochs is None else total_epochs,
        "status": F.lit("Starting..."), "error_message": F.lit(""), "last_batch_info": F.lit(""),
    }
    counts = ("current_epoch", "total_epochs")

    def said(name: str) -> Column:
        value = F.coalesce(F.col(name), start.get(name, F.lit(0)))
        return value.cast("bigint") if name in counts else value

    return condense(parsed).select(
        "run_id", *[said(n).alias(n) for n in runlog.LINE_FIELDS if n not in ("finished", "failed")], "finished", "failed"
    )


def final_progress(lines: DataFrame, total_epochs: Column | None = None) -> DataFrame:
    """Progress of each run at its end, or at its first terminal line."""
    return fold_progress(parse_lines(until_terminal(lines)), total_epochs)


def progress_by_line(lines: DataFrame, max_rows_per_key: int | None = None) -> DataFrame:
    """Progress after every line, up to and including the first terminal one."""
    parsed = informative(parse_lines(lines))
    carried = ["current_epoch", "total_epochs", "train_loss", "train_acc", "val_loss", "val_acc",
               "status", "last_batch_info"]
    ended = (F.col("finished") | F.col("failed")).cast("int")
    steps = [Running(f"now_{n}", "last", F.col(n)) for n in carried]
    steps += [Running("now_best", "max", F.col("val_acc")), Running("_ended", "max", ended, before=True)]
    folded = running(parsed, ["run_id"], ["seq"], steps, max_rows_per_key, sized_by=lines)
    start = {"status": "Starting...", "last_batch_info": ""}
    return folded.filter(F.coalesce(F.col("_ended"), F.lit(0)) == 0).select(
        "run_id",
        "seq",
        *[F.coalesce(F.col(f"now_{n}"), F.lit(start.get(n, 0))).alias(n) for n in carried],
        F.greatest(F.coalesce(F.col("now_best"), F.lit(0.0)), F.lit(0.0)).alias("best_acc"),
        "finished",
        "failed",
    )


def run_outcome(ends: DataFrame, exit_codes: DataFrame) -> DataFrame:
    """How each run ended: by its marker, otherwise by its exit code.

    `ends` needs `(run_id, finished, failed)`, so run ends will do as well as full progress.
    """
    joined = ends.join(exit_codes.select("run_id", "exit_code"), "run_id", "left")
    by_code = F.when(F.col("exit_code") == 0, "success").otherwise("failure")
    return joined.withColumn(
        "outcome",
        F.when(F.col("finished"), "success").when(F.col("failed"), "failure").otherwise(by_code),
    )


def tail(df: DataFrame, run: str, order: str, n: int) -> DataFrame:
    """Last n rows of every run; tasks drop all others before the shuffle."""
    newest = Window.partitionBy(run).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def failure_tail(lines: DataFrame, outcomes: DataFrame, n: int = FAILURE_LINES) -> DataFrame:
    """Last lines of the runs that ended without a marker and with a bad exit code."""
    lost = outcomes.filter((F.col("outcome") == "failure") & ~F.col("failed")).select("run_id")
    return tail(lines, "run_id", "seq", n).join(lost, "run_id", "left_semi")


def replayed_progress(lines: DataFrame, n: int = REPLAY_LINES) -> DataFrame:
    """Progress rebuilt from the last n lines of each run."""
    recent = tail(lines, "run_id", "seq", n)
    # A run has n rows here at most, so its end is found in the same order that the tail was cut in.
    end = F.min(F.when(_ends_a_run(), F.col("seq"))).over(Window.partitionBy("run_id"))
    within = recent.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    return fold_progress(parse_lines(within.drop("_end")))


def _seconds_between(df: DataFrame, at: str, later: Column, earlier: Column) -> Column:
    """Seconds between two times of the type of column `at`; times without a zone never shift with one."""
    if isinstance(df.schema[at].dataType, T.TimestampNTZType):
        span = T.DayTimeIntervalType(T.DayTimeIntervalType.SECOND, T.DayTimeIntervalType.SECOND)
        return (later - earlier).cast(span).cast("decimal(20,6)").cast("double")
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000


def elapsed(df: DataFrame, run: str, at: str) -> DataFrame:
    """Seconds between the first and the last row of each run, and as text."""
    return (
        df.groupBy(run)
        .agg(_seconds_between(df, at, F.max(at), F.min(at)).alias("seconds"))
        .withColumn("elapsed", runlog.elapsed_text(F.col("seconds")))
    )


def time_left(
    df: DataFrame, run: str, order: Sequence[str], at: str, total: Column, max_rows_per_key: int | None = None
) -> DataFrame:
    """After each epoch row: epochs done, share, bar, and the time left at the pace so far."""
    steps = [Running("done", "count"), Running("_start", "min", F.col(at))]
    counted = running(df, [run], order, steps, max_rows_per_key).withColumn("total", total.cast("bigint"))
    done, of = F.col("done"), F.col("total")
    seconds = _seconds_between(df, at, F.col(at), F.col("_start"))
    return counted.withColumns(
        {
            "fraction": runlog.progress_fraction(done, of),
            "bar": runlog.progress_bar(done, of),
            "eta": runlog.eta_text(seconds, done, of),
        }
    ).drop("_start")


def retry_outcome(attempts: DataFrame, infrastructure: Column | None = None) -> DataFrame:
    """Outcome of runs that try at most three times and give up on an infrastructure error.

    Takes `(run_id, attempt, exit_code, log)`. Any end but success reports three retries;
    `attempts_made` holds the true count.
    """
    broken = infrastructure if infrastructure is not None else contains_any(F.col("log"), INFRASTRUCTURE_MARKS)
    bad = F.col("exit_code") != 0
    grouped = (
        attempts.filter(F.col("attempt") <= MAX_ATTEMPTS)
        .groupBy("run_id")
        .agg(
            F.min(F.when(~bad, F.col("attempt"))).alias("_won"),
            F.min(F.when(bad & broken, F.col("attempt"))).alias("_broke"),
            F.max("attempt").alias("_last"),
        )
    )
    won = F.col("_won").isNotNull() & (F.col("_broke").isNull() | (F.col("_won") < F.col("_broke")))
    return grouped.select(
        "run_id",
        won.alias("succeeded"),
        F.when(won, F.col("_won") - 1).otherwise(MAX_ATTEMPTS).cast("int").alias("retry_count"),
        F.when(won, F.col("_won")).otherwise(F.coalesce("_broke", "_last")).cast("int").alias("attempts_made"),
        F.when(~won, F.lit(f"Mock run failed after {MAX_ATTEMPTS} attempts")).alias("error_message"),
    )
