"""Profile of a dataset: counts per extension, directory and class, size, uniform sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelyard.functions.text import file_extension, parent_dir
from modelyard.operators.splits import hash_key

# Names drawn and names shown.
SAMPLE_SIZE = 50
SHOWN_SIZE = 10


def extension_counts(df: DataFrame, path: Column) -> DataFrame:
    return df.groupBy(file_extension(path).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def directory_counts(df: DataFrame, path: Column) -> DataFrame:
    return df.groupBy(parent_dir(path).alias("dir")).agg(F.count(F.lit(1)).alias("n"))


def dataset_profile(df: DataFrame, path: Column) -> DataFrame:
    """Total, extension and directory counts in long form `(kind, key, n)`.

    Files are first counted per (directory, extension); only those counts are spread out.
    """
    counted = df.groupBy(parent_dir(path).alias("dir"), file_extension(path).alias("ext")).agg(
        F.count(F.lit(1)).alias("n")
    )
    facts = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")),
        F.struct(F.lit("ext").alias("kind"), F.col("ext").alias("key")),
        F.struct(F.lit("dir").alias("kind"), F.col("dir").alias("key")),
    )
    return counted.select(F.inline(facts), "n").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class; reported, never an error."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def uniform_sample(df: DataFrame, id_column: str, size: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """Exactly min(size, rows) rows without replacement, the same for the same seed.

    Ordering by a hash with a limit keeps `size` rows per task, with no full sort.
    """
    return df.orderBy(hash_key(F.col(id_column), str(seed)), id_column).limit(size)


def shown_sample(df: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """The first rows of that sample, as shown to a reader."""
    return uniform_sample(df, id_column, SHOWN_SIZE, seed)


def described(df: DataFrame, path: Column, id_column: str, labels: DataFrame, data_path: str, status: str) -> DataFrame:
    """The whole profile in long form: counts, classes, names of the sample, and where the data are and how they stand."""
    names = F.struct(path.alias("name"), F.col(id_column).alias("id"))
    sample = shown_sample(df.select(names.alias("_row")).select("_row.name", F.col("_row.id").alias(id_column)), id_column)
    facts = [("path", data_path), ("status", status)]
    known = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("key"), F.lit(1).cast("bigint").alias("n")) for k, v in facts])
    return (
        dataset_profile(df, path)
        .unionByName(labels.select(F.lit("class").alias("kind"), F.col("label").cast("string").alias("key"), "n"))
        .unionByName(sample.select(F.lit("sample").alias("kind"), F.col("name").alias("key"), F.lit(1).cast("bigint").alias("n")))
        .unionByName(df.sparkSession.range(1).select(F.inline(known)))
    )


SUMMARY_SCHEMA = "kind string, key string, n bigint, mark string, id string"


def summary(df: DataFrame, path: Column, id_column: str, seed: int = 42) -> DataFrame:
    """What can be added up of a profile: the counts, and the rows of the sample with the hashes that they were drawn by."""
    names = df.select(path.alias("key"), F.col(id_column).alias("id"))
    sample = uniform_sample(names, "id", SAMPLE_SIZE, seed)
    counts = dataset_profile(df, path).select("kind", "key", "n", F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("id"))
    drawn = sample.select(
        F.lit("sample").alias("kind"), "key", F.lit(1).cast("bigint").alias("n"), hash_key(F.col("id"), str(seed)).alias("mark"), F.col("id").cast("string").alias("id")
    )
    return counts.unionByName(drawn)


def merged_summaries(summaries: DataFrame) -> DataFrame:
    """The summary of all rows out of those of disjoint parts: of the sampled rows, those with the least hashes."""
    counts = summaries.filter("mark is null").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    nothing = F.lit(None).cast("string")
    drawn = summaries.filter("mark is not null").orderBy("mark", "id").limit(SAMPLE_SIZE)
    return counts.select("kind", "key", "n", nothing.alias("mark"), nothing.alias("id")).unionByName(drawn)


def size_check(counts: DataFrame, minimum: int, recommended: int) -> DataFrame:
    """Severity of a row count against the minimum and the recommended size."""
    severity = F.when(F.col("n") < minimum, "error").when(F.col("n") < recommended, "warning")
    return counts.withColumn("severity", severity)


def batch_count(rows: Column, batch_size: int = 64) -> Column:
    """Batches an epoch takes, the last one partial."""
    return F.ceil(rows / batch_size).cast("bigint")


def naming_share(df: DataFrame, name: Column, pattern: str) -> DataFrame:
    """How many names follow a convention."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(name.rlike(pattern)).alias("matching"),
    ).withColumn("share", F.when(F.col("n") > 0, F.col("matching") / F.col("n")))
