"""Splits, shuffles and batches that depend on ids only, never on the layout of the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelyard.operators.ordered import Running, running

# Batch size and how often a batch is reported.
BATCH_SIZE = 64
REPORT_EVERY = 100

ROWS_PER_BLOCK = 500_000
#: Offsets of blocks are added up over so many hex digits at a time, 4,096 blocks of one parent per window.
DIGITS_AT_ONCE = 3


def hash_key(id_column: Column, seed: str = "") -> Column:
    """md5 of the id, never null, so that no row is lost on it."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text) if seed else text)


def hash_bucket(id_column: Column, buckets: int, seed: str = "") -> Column:
    """A bucket from 0 to buckets-1 out of the md5 of the id."""
    return F.conv(F.substring(hash_key(id_column, seed), 1, 8), 16, 10).cast("bigint") % buckets


def train_test_split(df: DataFrame, id_column: str, train_tenths: int = 8) -> DataFrame:
    """Add `split`; a split that the table already holds is kept."""
    if "split" in df.columns:
        return df
    bucket = hash_bucket(F.col(id_column), 10)
    return df.withColumn("split", F.when(bucket < train_tenths, "train").otherwise("test"))


def block_offsets(counts: DataFrame, digits: int) -> DataFrame:
    """_block, _offset: the rows of all blocks before each, out of `_block` (so many hex digits) and `_n`.

    Blocks are summed up to those with fewer digits, whose offsets are found in the same way; a window only ever holds the
    blocks of one parent.
    """
    if digits <= DIGITS_AT_ONCE:
        before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    parent = F.substring("_block", 1, digits - DIGITS_AT_ONCE).alias("_parent")
    parents = block_offsets(counts.groupBy(parent.alias("_block")).agg(F.sum("_n").alias("_n")), digits - DIGITS_AT_ONCE)
    before = Window.partitionBy("_parent").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select("_block", parent, "_n").withColumn("_within", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = within.join(parents.withColumnsRenamed({"_block": "_parent", "_offset": "_before"}), "_parent")
    return joined.select("_block", (F.col("_before") + F.col("_within")).alias("_offset"))


def shuffled_batches(
    df: DataFrame, id_column: str, epoch: int, seed: int = 42, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Add `position` and `batch` in an order drawn anew for every epoch.

    The order is that of an md5, so its leading hex digits cut the rows into even blocks that
    are a function of the id alone: block counts give each block its offset, and rows are
    numbered inside their block. No step sorts the whole table in one task, and blocks keep their
    size however many there are, as their offsets are summed up along the digits. Ids should be unique;
    rows that share one are put in the order of a hash of their columns.
    """
    wanted_blocks = max(df.count() / ROWS_PER_BLOCK, 1)
    digits = min(max(1, math.ceil(math.log(wanted_blocks, 16))), 32)
    keyed = df.withColumn("_key", hash_key(F.col(id_column), f"{seed}:{epoch}")).withColumn("_block", F.substring("_key", 1, digits))
    counts = keyed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = block_offsets(counts, digits)
    in_block = Window.partitionBy("_block").orderBy("_key", id_column, F.xxhash64(*df.columns))
    return (
        keyed.withColumn("_rank", F.row_number().over(in_block) - 1)
        .join(offsets, "_block")
        .withColumn("position", F.col("_offset") + F.col("_rank"))
        .withColumn("batch", F.floor(F.col("position") / batch_size).cast("bigint"))
        .drop("_key", "_block", "_rank", "_offset")
    )


def ordered_batches(df: DataFrame, id_column: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Batches in id order, as for the test split; the last one may be partial."""
    counted = running(df, [], [id_column], [Running("position", "count", before=True)])
    return counted.withColumn("batch", F.floor(F.col("position") / batch_size).cast("bigint"))


def every_nth(df: DataFrame, index: Column, n: int = REPORT_EVERY) -> DataFrame:
    return df.filter(index % n == 0)
