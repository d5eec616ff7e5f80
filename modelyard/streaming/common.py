"""Starting streams from folders and running them to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modelyard.session import delete_folder, is_folder

LINE_SCHEMA = "run_id string, seq bigint, line string"


# What one micro-batch may take in where state functions hold the rows of a key, and elsewhere.
STATE_BATCH_BYTES = 256 << 20
BATCH_BYTES = 1 << 40


def table_stream(
    spark: SparkSession, folder: str, name: str, schema, max_bytes_per_trigger: int = BATCH_BYTES
) -> DataFrame:
    """One Parquet table as a stream: the part files of its folder, or its single file among its neighbours."""
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_trigger)
    path = f"{folder}/{name}.parquet"
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def line_stream(spark: SparkSession, folder: str, max_bytes_per_trigger: int = STATE_BATCH_BYTES) -> DataFrame:
    """Log lines followed as files arrive."""
    return (
        spark.readStream.schema(LINE_SCHEMA).option("maxBytesPerTrigger", max_bytes_per_trigger).json(folder)
    )


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what has arrived into a Parquet sink and stop.

    Run again with the same checkpoint it takes up where it left off.
    """
    (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
        .awaitTermination()
    )


def batches_of(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the folders `batch=N` below a folder; what is in them is not opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [status.getPath().getName() for status in found if status.isDirectory()]
    return [int(name.removeprefix("batch=")) for name in names if name.startswith("batch=")]


def forget_batch(spark: SparkSession, folder: str, batch: int) -> None:
    """Delete the snapshot of a batch that no later one will ask for."""
    path = f"{folder}/batch={batch}"
    if is_folder(spark, path):
        delete_folder(spark, path)
