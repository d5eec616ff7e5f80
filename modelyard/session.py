"""Sessions, shared folders and limits."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_KEY = "spark.modelyard.maxRowsPerKey"


def local_session(name: str = "modelyard", cpus: int | str = "*") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local master without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="modelyard-")
    if not named.strip():
        raise RuntimeError("spark.checkpoint.dir is empty")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark).rstrip('/')}/modelyard/{purpose}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by `new_folder`."""
    if "/modelyard/" not in path:
        raise ValueError(f"not a folder of ours: {path}")
    delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all: written beside its place and then renamed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"cannot rename to {path}")


def read_whole(spark: SparkSession, path: str) -> str:
    """A small file written by `write_whole`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of what is in a folder, nothing if there is no such folder."""
    if not is_folder(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(status.getPath().getName() for status in found)


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that partition numbers stay what they are."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage by writing the rows once to the shared folder and reading them back."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written to the shared folder for a while; `clear` deletes them once nothing will read them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, purpose: str) -> DataFrame:
        path = new_folder(self.spark, purpose)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            discard(self.spark, self.paths.pop())
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done: it does when the driver has collected their plans."""
    gc.collect()
    spark._jvm.System.gc()


def limit_setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))
