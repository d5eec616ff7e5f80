"""Reading training-log lines; durations and progress as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of the log lines, and the numbers in them.
EPOCH_LINE = r"Epoch \d+/\d+"
BATCH_LINE = r"Batch \d+/\d+ - Loss: [\d.]+"
TRAIN_LINE = r"Epoch \d+ Training - Loss: [\d.]+, Accuracy: [\d.]+"
VALID_LINE = r"Epoch \d+ Validation - Loss: [\d.]+, Accuracy: [\d.]+"
NUMBER = r"[\d.]+"
FINISHED_MARK = "Training process finished successfully"
FAILED_MARK = "Training failed"
CRITICAL_MARK = "critical error"
BAR_WIDTH = 30

LINE_FIELDS = (
    "current_epoch", "total_epochs", "train_loss", "train_acc", "val_loss", "val_acc", "best_acc",
    "status", "finished", "failed", "error_message", "last_batch_info",
)


def _numbers(line: Column, guard: Column, pattern: str) -> Column:
    """The numbers of a pattern in order, tried only on lines that pass a plain substring test."""
    return F.when(guard, F.regexp_extract_all(F.regexp_extract(line, pattern, 0), F.lit(NUMBER), F.lit(0)))


def is_finished(line: Column) -> Column:
    return line.contains(FINISHED_MARK)


def is_failed(line: Column) -> Column:
    return line.contains(FAILED_MARK) | F.lower(line).contains(CRITICAL_MARK)


def line_parts(line: Column) -> Column:
    """The pieces of one line as a struct; no numbers where a pattern does not occur."""
    return F.struct(
        _numbers(line, line.contains("Epoch ") & line.contains("/"), EPOCH_LINE).alias("header"),
        _numbers(line, line.contains("Batch "), BATCH_LINE).alias("batch"),
        _numbers(line, line.contains(" Training - Loss: "), TRAIN_LINE).alias("trained"),
        _numbers(line, line.contains(" Validation - Loss: "), VALID_LINE).alias("validated"),
        is_finished(line).alias("finished"),
        is_failed(line).alias("failed"),
    )


def fields_of() -> dict[str, Column]:
    """What a line and its pieces say about each progress field; null where they say nothing.

    An epoch header counts the epochs before it, and a validation line empties the batch note.
    """

    def number(part: str, index: int) -> Column:
        return F.get(F.col(part), F.lit(index))

    epoch, trained, validated = number("header", 0), number("trained", 0), number("validated", 0)
    return {
        "current_epoch": F.coalesce(trained.try_cast("bigint"), epoch.try_cast("bigint") - 1),
        "total_epochs": number("header", 1).try_cast("bigint"),
        "train_loss": number("trained", 1).try_cast("double"),
        "train_acc": number("trained", 2).try_cast("double"),
        "val_loss": number("validated", 1).try_cast("double"),
        "val_acc": number("validated", 2).try_cast("double"),
        "best_acc": number("validated", 2).try_cast("double"),
        "status": F.when(F.col("failed"), F.lit("Training failed"))
        .when(F.col("finished"), F.lit("Training complete!"))
        .when(validated.isNotNull(), F.concat(F.lit("Epoch "), validated, F.lit(" complete")))
        .when(trained.isNotNull(), F.concat(F.lit("Epoch "), trained, F.lit(" — validating...")))
        .when(epoch.isNotNull(), F.concat(F.lit("Training epoch "), epoch, F.lit("/"), number("header", 1))),
        "finished": F.col("finished"),
        "failed": F.col("failed"),
        "error_message": F.when(F.col("failed"), F.col("line")),
        "last_batch_info": F.when(validated.isNotNull(), F.lit("")).when(
            number("batch", 0).isNotNull(),
            F.concat(
                F.lit("Batch "), number("batch", 0), F.lit("/"), number("batch", 1),
                F.lit(" | Loss: "), number("batch", 2),
            ),
        ),
    }


def _split_seconds(seconds: Column) -> tuple[Column, Column, Column]:
    whole = seconds.cast("bigint")
    minutes = F.floor(whole / 60).cast("bigint")
    return (
        F.floor(minutes / 60).cast("bigint"),
        F.pmod(minutes, F.lit(60)),
        F.pmod(whole, F.lit(60)),
    )


def elapsed_text(seconds: Column) -> Column:
    """`Xh Ym Zs`, or `Ym Zs` below an hour."""
    h, m, s = _split_seconds(seconds)
    short = F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s"))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), short)).otherwise(short)


def eta_seconds(elapsed: Column, current: Column, total: Column) -> Column:
    """Seconds left at the pace so far; null before the first epoch or without a total."""
    return F.when((current != 0) & (total != 0), elapsed / current * (total - current))


def eta_text(elapsed: Column, current: Column, total: Column) -> Column:
    """`calculating...`, `~Xh Ym` or `~Ym Zs`."""
    h, m, s = _split_seconds(eta_seconds(elapsed, current, total))
    return (
        F.when((current == 0) | (total == 0), F.lit("calculating..."))
        .when(h > 0, F.concat(F.lit("~"), h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
        .otherwise(F.concat(F.lit("~"), m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s")))
    )


def progress_fraction(current: Column, total: Column) -> Column:
    """Share of epochs done; null without a total."""
    return F.when(total != 0, current / total)


def progress_bar(current: Column, total: Column, width: int = BAR_WIDTH) -> Column:
    """`[███░░░] 50%`; question marks without a total."""
    filled = F.least(F.greatest((F.lit(width) * current / total).cast("int"), F.lit(0)), F.lit(width))
    bar = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
    percent = F.bround(F.lit(100) * current / total, 0).cast("bigint").cast("string")
    return F.when(total == 0, F.lit("[" + "?" * width + "]")).otherwise(
        F.concat(F.lit("["), bar, F.lit("] "), percent, F.lit("%"))
    )
