"""Mixing sources to target weights, built from DataFrame operations only.

Every source's words are laid out on a line and packed into blocks of a fixed length. The mix is a row of slots, cut into
output shards. For every shard the number of slots per source is a multinomial draw; what a source drew beyond its quota
goes to sources that fell short, so that quotas hold exactly. The slots of a source are numbered through all shards and go
through a pseudorandom permutation of the source's blocks, a new one for each pass over the source; slots and blocks
then meet in a join on the block's index.

Defined cases: null or empty texts have size 0 and are never taken; a null source is a source of its own, after all others;
repeated rows are documents of their own; an empty table gives no rows; other columns are not looked at. Order and
permutations depend on ids, sizes and texts alone, so reruns and other layouts agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelyard.session import pinned

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
MOST_BROADCAST = 100_000
PRIME = 2147483647
STEPS = (1000000007, 998244353)


@dataclass(frozen=True)
class MixSettings:
    """block: words per block; shard: slots per output shard; most: how often a source may be used up."""

    block: int = 2048
    shard: int = 65536
    most: int = 3
    weights: tuple[int, ...] = (1, 2, 3)
    seed: int = 7


def word_count(text: Column) -> Column:
    """Words without building them: every word becomes one letter, and the spaces go."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, and the place of the document in its source's order: bucket, then id, size, digest."""
    chosen = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.coalesce(F.md5(F.col(text)), F.lit("")).alias("digest"),
    )
    head = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8)
    return chosen.withColumn("bucket", F.conv(head, 16, 10).cast("long") % BUCKETS)


def targets(sizes: DataFrame, settings: MixSettings) -> DataFrame:
    """One row per source: sid, source, source_size, target (see `mix`). Windows run over sources, never over documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(w) for w in settings.weights])
    named = totals.withColumn("sid", F.row_number().over(by_name).cast("long")).withColumns(
        {
            "weight": F.get(choices, ((F.col("sid") - 1) % len(settings.weights)).cast("int")).cast("long"),
            "cap": F.col("source_size") * settings.most,
        }
    )
    # Filled like vessels: in order of cap per weight, a source is full if its share of what is left exceeds its cap.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = named.withColumns({"level": left / weight_left, "place": F.row_number().over(fill)})
    open_ = F.col("cap") / F.col("weight") >= F.col("level")
    level = F.min(F.when(open_, F.struct("place", "level"))).over(everything)
    filled = filled.withColumn("last", level)
    return filled.select(
        "sid",
        "source",
        "source_size",
        F.when(F.col("place") < F.col("last.place"), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("last.level")))
        .alias("target"),
    )


def quotas(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """Per source: wanted words, full blocks, blocks, and the number of slots that give exactly the wanted words."""
    size, b = F.col("source_size"), settings.block
    return (
        sources.withColumns({"wanted": F.floor("target").cast("long"), "full": F.floor(size / b).cast("long")})
        .withColumn("blocks", F.col("full") + F.when(size % b > 0, 1).otherwise(0))
        .withColumn("passes", F.when(size > 0, F.floor(F.col("wanted") / size)).otherwise(0).cast("long"))
        .withColumn("rest", F.col("wanted") - F.col("passes") * size)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long"))
    )


def _mixed(x: Column, salt: Column) -> Column:
    """Pseudorandom in [0, PRIME), for x of at least 0; plain arithmetic that any SQL engine repeats."""
    once = ((x % PRIME) * 48271 + salt * 40692 + 12345) % PRIME
    return (once * 1103515245 + 69621) % PRIME


def permuted(index: Column, size: Column, salt: Column) -> Column:
    """A pseudorandom permutation of 0..size-1: step, two Feistel rounds over the largest near-square part, step."""

    def step(x: Column, add: Column) -> Column:
        factor = F.when(size % STEPS[0] == 0, F.lit(STEPS[1])).otherwise(F.lit(STEPS[0]))
        return (x * (factor % size) + add) % size

    rows = F.floor(F.sqrt(size.cast("double"))).cast("long")
    columns = F.floor(size / rows).cast("long")
    first = step(index, _mixed(salt, F.lit(1)))
    left, right = F.floor(first / columns).cast("long"), first % columns
    left_after = (left + _mixed(right, salt + 1)) % rows
    right_after = (right + _mixed(left_after, salt + 2)) % columns
    second = F.when(first < rows * columns, left_after * columns + right_after).otherwise(first)
    return step(second, _mixed(salt, F.lit(3)))


def shard_counts(quota: DataFrame, settings: MixSettings) -> DataFrame:
    """shard, sid, count: multinomial draws per shard, corrected to the quotas."""
    spark = quota.sparkSession
    total = quota.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    shards = -(-total // settings.shard)
    draws = spark.range(total).select(
        F.floor(F.col("id") / settings.shard).cast("long").alias("shard"),
        (F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(max(total, 1)))).alias("u"),
        F.lit(None).cast("long").alias("sid"),
    )
    above = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = quota.withColumn("u", F.coalesce(F.sum("slots").over(above), F.lit(0))).filter("slots > 0")
    every = F.sequence(F.lit(0).cast("long"), F.lit(max(shards - 1, 0)).cast("long"))
    marks = ranges.select(F.explode(every).alias("shard"), "u", "sid")
    # Inverse distribution function by a merge: a draw belongs to the last source whose range begins at or before it.
    merged = Window.partitionBy("shard").orderBy("u", F.col("sid").asc_nulls_last())
    drawn = (
        draws.unionByName(marks)
        .withColumn("hit", F.last("sid", ignorenulls=True).over(merged))
        .groupBy("shard", F.col("hit").alias("sid"))
        .agg(F.count_if(F.col("sid").isNull()).alias("drawn"))
    )
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("slots") - F.coalesce(F.sum("drawn").over(earlier), F.lit(0))
    kept = pinned(
        drawn.join(quota.select("sid", "slots"), "sid")
        .withColumn("kept", F.least(F.col("drawn"), F.greatest(F.lit(0), room)))
        .select("shard", "sid", "slots", "drawn", "kept")
    )
    over = kept.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("n")).filter("n > 0")
    short = kept.groupBy("sid").agg((F.max("slots") - F.sum("kept")).alias("n")).filter("n > 0")
    moved = _numbered(over, "shard").join(_numbered(short, "sid"), "unit").groupBy("shard", "sid").agg(
        F.count(F.lit(1)).alias("kept")
    )
    both = kept.select("shard", "sid", "kept").unionByName(moved.select("shard", "sid", "kept"))
    return both.groupBy("shard", "sid").agg(F.sum("kept").alias("count")).filter("count > 0")


def _numbered(counted: DataFrame, key: str) -> DataFrame:
    """One row per unit of n, numbered through; there are about the square root of as many units as slots."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    return counted.withColumn("first", first).select(
        key, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("unit")
    )


def slots(counts: DataFrame, quota: DataFrame, settings: MixSettings) -> DataFrame:
    """shard, sid, slot (number within the source), block, words: which block fills each slot, and how much of it."""
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("count").over(earlier), F.lit(0))
    numbered = (
        counts.withColumn("first", first)
        .select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))
        .join(quota.drop("source", "target"), "sid")
    )
    in_pass = F.col("slot") % F.col("blocks")
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    salt = F.col("sid") * 31 + turn * 17 + settings.seed
    block = F.when(in_pass < F.col("full"), permuted(in_pass, F.col("full"), salt)).otherwise(in_pass)
    length = F.when(in_pass < F.col("full"), F.lit(settings.block)).otherwise(F.col("source_size") % settings.block)
    left = F.col("wanted") - turn * F.col("source_size") - in_pass * settings.block
    return numbered.select(
        "shard", "sid", "slot", block.alias("block"), F.least(length.cast("long"), left).alias("words")
    )


def placed(sizes: DataFrame) -> DataFrame:
    """Add `first`, the document's first word on its source's line, and `nth`, its number within the bucket.

    Sources are cut into buckets by a hash of the id, so that a source with a third of all rows spreads over 4,096 groups;
    what crosses buckets is one total per source and bucket.
    """
    buckets = sizes.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("sid", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("bucket_first"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "digest")
    local = sizes.withColumns(
        {
            "nth": F.row_number().over(inside),
            "local": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
        }
    )
    return local.join(offsets, ["sid", "bucket"]).withColumn("first", F.col("bucket_first") + F.col("local"))


def packed(at: DataFrame, settings: MixSettings) -> DataFrame:
    """One row per document and block that it reaches into, with the stretch of the block it fills; a row for empty ones."""
    b = settings.block
    first, end = F.col("first"), F.col("first") + F.col("size")
    reach = F.when(
        F.col("size") > 0, F.sequence(F.floor(first / b).cast("long"), F.floor((end - 1) / b).cast("long"))
    )
    return (
        at.withColumn("block", F.explode_outer(reach))
        .withColumns(
            {
                "from": F.greatest(first, F.col("block") * b) - F.col("block") * b,
                "until": F.least(end, (F.col("block") + 1) * b) - F.col("block") * b,
            }
        )
        .drop("first", "local", "bucket_first")
    )


@dataclass(frozen=True)
class Mix:
    """slots: shard, sid, slot, block, words. pieces: documents by block. sources: targets and quotas."""

    slots: DataFrame
    pieces: DataFrame
    sources: DataFrame

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken; one row per document."""
        joined = self.pieces.join(self.slots.select("sid", "block", "words"), ["sid", "block"], "left")
        overlap = F.greatest(F.lit(0), F.least("until", "words") - F.col("from"))
        return (
            joined.groupBy("sid", "bucket", "nth", "doc_id", "size", "source_size", "target")
            .agg(F.coalesce(F.sum(F.when(F.col("words").isNotNull(), overlap)), F.lit(0)).alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken")
        )


def mix(docs: DataFrame, settings: MixSettings | None = None, **columns: str) -> Mix:
    """Sources in order of code points weigh 1, 2, 3, 1, ... and share as many words as there are.

    No source gives more than `most` times its size; what it cannot give goes to the others by weight.
    """
    settings = settings or MixSettings()
    sizes = pinned(sized(docs, **columns))
    sources = pinned(quotas(targets(sizes, settings), settings))
    small = F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources
    keyed = sizes.alias("a").join(
        small.select("sid", F.col("source").alias("name"), "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))
    )
    pieces = packed(placed(keyed.drop("name", "source")), settings)
    return Mix(slots(shard_counts(sources, settings), sources, settings), pieces, sources)
