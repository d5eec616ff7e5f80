"""Rules over tables: every rule of a table is counted in one pass, then rolled up to a status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed words, class range, built-in sources.
PROJECT_TYPES = ("vision", "nlp", "tabular", "time-series", "multimodal", "rl", "other")
FRAMEWORKS = ("pytorch", "tensorflow", "jax", "scikit-learn")
SEVERITIES = ("error", "warning")
STATUSES = ("pass", "warn", "fail")
CLASS_RANGE = (2, 10000)
BUILT_IN_SOURCES = ("torchvision", "MNIST", "CIFAR10", "CIFAR100", "FashionMNIST", "ImageNet")


@dataclass(frozen=True)
class Rule:
    """One check of one column.

    kind: required, positive, range (null passes), allowed, allowed_any_case.
    """

    column: str
    kind: str
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()
    severity: str = "error"
    fix: str = ""

    @property
    def name(self) -> str:
        return f"{self.column} {self.kind}"

    def violated(self) -> Column:
        c = F.col(self.column)
        if self.kind == "required":
            return c.isNull()
        if self.kind == "positive":
            return c.isNull() | ~(c > 0)
        if self.kind == "range":
            return c.isNotNull() & ~c.between(self.low, self.high)
        if self.kind == "allowed":
            return c.isNull() | ~c.isin(*self.allowed)
        if self.kind == "allowed_any_case":
            return c.isNull() | ~F.lower(c).isin(*self.allowed)
        raise ValueError(f"unknown rule kind: {self.kind}")


# The rules a project specification must meet.
SPEC_RULES = (
    Rule("project_type", "allowed_any_case", allowed=PROJECT_TYPES, fix="use a known project type"),
    Rule("framework", "allowed_any_case", allowed=FRAMEWORKS, fix="use a known framework"),
    Rule("task", "required", fix="state the task"),
    Rule("num_classes", "range", *CLASS_RANGE, fix="use 2 to 10000 classes"),
)

# The rules issues and results must meet; case counts here.
ISSUE_RULES = (
    Rule("severity", "allowed", allowed=SEVERITIES, fix="use error or warning"),
    Rule("message", "required", fix="say what is wrong"),
    Rule("fix", "required", fix="say what helps"),
)
RESULT_RULES = (Rule("status", "allowed", allowed=STATUSES, fix="use pass, warn or fail"),)

# What a specification holds when nothing is said.
SPEC_DEFAULTS = {
    "dataset_source": "custom",
    "pretrained": False,
    "compute_budget": "medium",
    "latency_priority": "balanced",
}
OPEN_MAP = "additional_requirements"


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def clean_specs(specs: DataFrame) -> DataFrame:
    """Specifications with project type and framework in lower case and defaults filled in; no further requirements is an empty map."""
    lowered = specs.withColumns({c: F.lower(c) for c in ("project_type", "framework")})
    further = F.col(OPEN_MAP) if OPEN_MAP in specs.columns else F.lit(None)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return fill_defaults(lowered, SPEC_DEFAULTS).withColumn(OPEN_MAP, F.coalesce(further, empty))


def known_source(c: Column, sources: Sequence[str] = BUILT_IN_SOURCES) -> Column:
    """Sources that need no validation."""
    return F.coalesce(c.isin(*sources), F.lit(False))


def count_violations(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: `(table, rule, severity, fix, violations)`, from one scan."""
    counts = df.agg(*[F.count_if(r.violated()).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = F.array(
        *[
            F.struct(
                F.lit(table).alias("table"),
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.fix).alias("fix"),
                F.col(f"r{i}").alias("violations"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return counts.select(F.inline(rows))


def as_issues(violations: DataFrame) -> DataFrame:
    """Rules that were broken, as issues `(table, severity, message, fix)`."""
    return violations.filter("violations > 0").select(
        "table",
        "severity",
        F.concat(F.col("rule"), F.lit(": "), F.col("violations").cast("string"), F.lit(" rows")).alias("message"),
        "fix",
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def status_of(severities: Column) -> Column:
    """Aggregate over issues: any error fails, any warning warns, otherwise pass."""
    worst = F.max(F.when(severities == "error", 2).when(severities == "warning", 1).otherwise(0))
    return F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass")


def roll_up(checks: DataFrame, by: str = "table") -> DataFrame:
    """Status per subject from `(subject, rule, severity, violations)` rows.

    The failing names are at most as many as there are rules.
    """
    broken = F.col("violations") > 0
    return checks.groupBy(by).agg(
        status_of(F.when(broken, F.col("severity"))).alias("status"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(broken).alias("broken"),
        F.bool_and(~broken).alias("all_passed"),
        F.array_join(F.array_sort(F.collect_set(F.when(broken, F.col("rule")))), ", ").alias("failing"),
    )


def may_continue(status: Column) -> Column:
    """Only `fail` stops the next step."""
    return status != "fail"


def column_check(df: DataFrame, table: str, expected: T.StructType) -> DataFrame:
    """Each expected column: expected and found type, verdict, rows that hold a value."""
    found = {f.name: f.dataType for f in df.schema.fields}
    here = [f for f in expected.fields if f.name in found]
    filled = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f.name).alias(f"_n_{f.name}") for f in here])

    def verdict(field: T.StructField) -> str:
        if field.name not in found:
            return "missing"
        return "ok" if found[field.name] == field.dataType else "mistyped"

    rows = F.array(
        *[
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("expected"),
                F.lit(found[f.name].simpleString() if f.name in found else None).cast("string").alias("found"),
                F.lit(verdict(f)).alias("verdict"),
                (F.col(f"_n_{f.name}") if f.name in found else F.lit(0)).cast("bigint").alias("filled"),
            )
            for f in expected.fields
        ]
    )
    return filled.select(F.inline(rows))


def missing_items(expected: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Expected items that were not found."""
    return expected.join(found.select(name).distinct(), name, "left_anti")


def any_found(expected: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """True when at least one expected item is there; only their total absence is an error."""
    return found.join(expected, name, "left_semi").agg((F.count(F.lit(1)) > 0).alias("found"))
