"""Tables, state records, manifests and checkpoints."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelyard.operators.metrics import best_epoch
from modelyard.operators.profile import SUMMARY_SCHEMA, merged_summaries
from modelyard.session import delete_folder, is_folder, names_in, read_whole, write_whole

STATE_SCHEMA = "project_id string, state string, at timestamp_ntz, seq bigint, spec map<string,string>"
PROFILE_SCHEMA = "kind string, key string, n bigint"
CHECKPOINT_SCHEMA = (
    "name string, shape array<int>, values array<double>, accuracy double, best_accuracy double, run_id string, epoch int"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- state records: an append-only table of lifecycle events


def append_states(states: DataFrame, path: str) -> None:
    states.write.mode("append").json(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).json(path)


# ---- manifest


def write_manifest(profile: DataFrame, issues: DataFrame, path: str) -> None:
    """Profile and issues in long form, so a dataset with many directories stays many rows."""
    profile.write.mode("overwrite").json(f"{path}/profile")
    issues.write.mode("overwrite").json(f"{path}/issues")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).json(f"{path}/profile")


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table string, severity string, message string, fix string").json(f"{path}/issues")


def add_summary(summary: DataFrame, path: str, part: str) -> None:
    """Note the summary of one part of a dataset, such as a folder; noted again it replaces only itself."""
    summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/summaries/part={part}")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of all parts that were noted, without a look at the files of any."""
    return merged_summaries(spark.read.schema(f"{SUMMARY_SCHEMA}, part string").parquet(f"{path}/summaries").drop("part"))


def data_context(projects: DataFrame, manifests: DataFrame, requirements: DataFrame) -> DataFrame:
    """What is known of each project's data: its manifest, else its requirements, else its source.

    Takes `(project_id, dataset_source)`, `(project_id, manifest)` and `(project_id, requirements)`.
    A manifest that is no JSON counts as missing.
    """
    manifest = F.when(F.try_parse_json("manifest").isNotNull(), F.col("manifest"))
    return (
        projects.join(manifests.select("project_id", "manifest"), "project_id", "left")
        .join(requirements.select("project_id", "requirements"), "project_id", "left")
        .select(
            "project_id",
            F.coalesce(
                manifest, F.col("requirements"), F.concat(F.lit("Dataset source: "), "dataset_source")
            ).alias("context"),
        )
    )


# ---- checkpoints: one partition per run and epoch, parameters as rows


def write_checkpoint(
    spark: SparkSession,
    path: str,
    epoch: int,
    parameters: dict[str, np.ndarray],
    accuracy: float,
    best: float,
    run_id: str = "run",
) -> None:
    """Parameters and optimizer state of one epoch of a run; written again it replaces only itself."""
    count = len(parameters)
    rows = pa.table(
        {
            "name": list(parameters),
            "shape": pa.array([list(v.shape) for v in parameters.values()], pa.list_(pa.int32())),
            "values": pa.array([v.astype(float).ravel() for v in parameters.values()], pa.list_(pa.float64())),
            "accuracy": [accuracy] * count,
            "best_accuracy": [best] * count,
        }
    )
    spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/run_id={run_id}/epoch={epoch}")


def start_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Forget the epochs of an earlier run of this name, which may have had more of them; their marks first."""
    for folder in (_marks(path, run_id), f"{path}/run_id={run_id}"):
        if is_folder(spark, folder):
            delete_folder(spark, folder)


def _marks(path: str, run_id: str) -> str:
    # Readers of tables pass over names that begin with an underscore.
    return f"{path}/_marks/run_id={run_id}"


def mark_epoch(spark: SparkSession, path: str, epoch: int, record: dict, run_id: str = "run") -> None:
    """Tell that the checkpoint of an epoch is complete, with what a resumed run has to know."""
    write_whole(spark, f"{_marks(path, run_id)}/epoch={epoch}", json.dumps(record))


def marked_epochs(spark: SparkSession, path: str, run_id: str = "run") -> list[int]:
    """The epochs of a run that are complete, in order."""
    names = names_in(spark, _marks(path, run_id))
    return sorted(int(name.removeprefix("epoch=")) for name in names if name.startswith("epoch="))


def read_mark(spark: SparkSession, path: str, epoch: int, run_id: str = "run") -> dict:
    return json.loads(read_whole(spark, f"{_marks(path, run_id)}/epoch={epoch}"))


def read_checkpoints(spark: SparkSession, path: str, run_id: str = "run") -> DataFrame:
    """The checkpoints of one run; where its epochs are marked, without one that is not complete."""
    rows = spark.read.schema(CHECKPOINT_SCHEMA).parquet(path).filter(F.col("run_id") == run_id)
    if not is_folder(spark, _marks(path, run_id)):
        return rows
    return rows.filter(F.col("epoch").isin(marked_epochs(spark, path, run_id)))


def best_or_last_epoch(checkpoints: DataFrame) -> int:
    """The best epoch, or the last one when no epoch scored above zero."""
    epochs = checkpoints.groupBy("epoch").agg(F.max("accuracy").alias("accuracy"))
    best = best_epoch(epochs, [], "accuracy", ["epoch"]).first()
    if best is not None and best["epoch"] is not None:
        return best["epoch"]
    return epochs.agg(F.max("epoch")).first()[0]


def load_parameters(checkpoints: DataFrame, epoch: int) -> dict[str, np.ndarray]:
    rows = checkpoints.filter(F.col("epoch") == epoch).select("name", "shape", "values").collect()
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows}
