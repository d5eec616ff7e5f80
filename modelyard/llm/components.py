"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelyard.session import pinned


def _with_least(pairs: DataFrame) -> DataFrame:
    """Every (node, neighbour) with the least of the node and its neighbours; partial minima before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach); nodes without links are left out.

    `links` has columns u and v. Each round moves every node closer to the least one it can see; the number of rounds is
    logarithmic, and what is kept per round is one row per link.
    """
    current = pinned(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        current = pinned(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = _state(current)
        if after == before:
            break
        before = after
    own = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
