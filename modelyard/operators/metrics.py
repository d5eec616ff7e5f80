"""Losses, accuracies, best epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelyard.operators.ordered import Running, running


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(value * weight) / sum(weight); null when the weights add up to 0."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def accuracy(predicted: Column, label: Column) -> Column:
    return F.avg((predicted == label).cast("int"))


def evaluate(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Rows, mean loss and accuracy of scored rows `(label, prediction, loss)`."""
    grouped = scored.groupBy(by) if by else scored.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("loss").alias("loss"),
        accuracy(F.col("prediction"), F.col("label")).alias("accuracy"),
    )


def running_best(
    df: DataFrame, run: Sequence[str], order: Sequence[str], value: str, max_rows_per_key: int | None = None
) -> DataFrame:
    """Best value up to each row and whether the row improved on it, starting from 0.0."""
    best = running(
        df, run, order, [Running("_before", "max", F.col(value), before=True)], max_rows_per_key
    )
    previous = F.coalesce(F.greatest(F.col("_before"), F.lit(0.0)), F.lit(0.0))
    return best.withColumns(
        {"best": F.greatest(previous, F.col(value)), "is_best": F.col(value) > previous}
    ).drop("_before")


def best_epoch(df: DataFrame, run: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The row that set the final best: the earliest one with the largest value above zero."""
    rank = F.struct((-F.col(value)).alias("v"), *[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in df.columns if c not in run])
    return (
        df.filter(F.col(value) > 0)
        .groupBy(*run)
        .agg(F.min_by(row, rank).alias("_best"))
        .select(*run, "_best.*")
    )
