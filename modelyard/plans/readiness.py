"""Is a labelled table fit to train on: class counts, sizes, rules, one status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelyard.operators.checks import Rule, as_issues, count_violations, may_continue, roll_up, union_all
from modelyard.operators.profile import class_distribution, size_check


def size_findings(df: DataFrame, table: str, label: str, minimum: int, recommended: int) -> DataFrame:
    """How many classes are below the minimum and below the recommended size, as two findings."""
    checked = size_check(class_distribution(df, label), minimum, recommended)
    levels = F.array(
        *[
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f"{label} {name}").alias("rule"),
                F.lit(severity).alias("severity"),
                F.lit("add samples").alias("fix"),
                F.col(severity).alias("violations"),
            )
            for name, severity in (("minimum size", "error"), ("recommended size", "warning"))
        ]
    )
    return checked.agg(
        F.count_if(F.col("severity") == "error").alias("error"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
    ).select(F.inline(levels))


def findings(tables: dict[str, tuple[DataFrame, Sequence[Rule]]], *more: DataFrame) -> DataFrame:
    """All rules of all tables, one scan per table."""
    return union_all([count_violations(df, name, rules) for name, (df, rules) in tables.items()] + list(more))


def readiness(checked: DataFrame) -> DataFrame:
    """Status per table, and whether work may go on."""
    return roll_up(checked).withColumn("may_continue", may_continue(F.col("status")))


def issues(checked: DataFrame) -> DataFrame:
    return as_issues(checked)
