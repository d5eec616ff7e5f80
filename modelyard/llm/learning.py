"""What the learned operators share: test rows, and labelled samples of a bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows kept for testing: the crc32 of the id as text leaves the remainder. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def chosen_labels(labels: DataFrame, learn: Column, doc_id: str, label: str, most: int, seed: int) -> DataFrame:
    """doc_id, label: at most `most` labelled documents, by the hash of the id; of contradicting labels the larger one."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & learn)
    single = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return single.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
