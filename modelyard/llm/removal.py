"""Taking documents out of a table, by their ids or row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelyard.session import pinned, stored

MOST_BROADCAST = 200_000


def small_side(rows: DataFrame) -> DataFrame:
    """Narrow rows as the side of a join with texts: up to 200,000 are sent to the tasks, more are shuffled and hashed.

    Either way the texts need not be sorted. `rows` are counted, so they should be pinned.
    """
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows.hint("shuffle_hash")


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, with as many underscores before it as no column of the tables has, whatever its case."""
    taken = {c.lower() for table in tables for c in table.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows whose id is not among `ids` (one column); rows without an id stay."""
    name = fresh("gone", docs)
    gone = pinned(ids.toDF(name).filter(F.col(name).isNotNull()).distinct())
    return docs.join(small_side(gone), F.col(doc_id) == F.col(name), "left_anti")


def told_apart(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows, and the name of a column that tells them apart: the id where no id is null or repeated, else a new one.

    Row numbers must not change between passes, so the numbered rows are written once.
    """
    times = docs.groupBy(F.col(doc_id).alias("id")).agg(F.count(F.lit(1)).alias("times"))
    if times.filter("id is null or times > 1").isEmpty():
        return docs, doc_id
    row = fresh("row", docs)
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def all_but_first(docs: DataFrame, groups: DataFrame, row: str, doc_id: str = "doc_id") -> DataFrame:
    """The rows that are not the first of their group; `groups` has `member` (a value of column `row`) and `component_id`.

    First is the smallest id, a null one only where there is no other; then the hash of the other columns decides, so that
    rows that share an id do not depend on the order in which they are read.
    """
    if row == doc_id:
        return groups.filter("member <> component_id").select("member")
    rest = [c for c in docs.columns if c not in (row, doc_id)]
    place = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(F.lit(0), *rest), F.col(row)).alias("place")
    several = groups.groupBy("component_id").count().filter("count > 1").select("component_id")
    members = groups.join(several, "component_id", "left_semi")
    placed = pinned(members.join(docs.select(F.col(row).alias("member"), place), "member"))
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    return placed.join(first, "component_id").filter(F.col("place") != F.col("first")).select("member")
