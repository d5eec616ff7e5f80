"""Running values per key in order, safe when one key holds most of the rows.

Keys of a checked size go through a plain window. Rows of larger keys are range-partitioned by
key and order, so that such a key spreads over many partitions (blocks); each block is summed
up on its own, and the only thing carried across is one row per block boundary. Where there are
many blocks, groups of them are summed up first, so that no window holds the blocks of a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelyard.session import ROWS_PER_KEY, limit_setting, pinned, stored

BLOCK = "_block"
#: Blocks that are summed up together, and the most whose carries are sent to all tasks; more are joined by a shuffle.
GROUP = 1_000
MOST_BROADCAST = 20_000


@dataclass(frozen=True)
class Running:
    """One running value.

    kind: count, sum, max, min, last (last non-null) or previous (value of the row before).
    before: leave the row itself out.
    """

    name: str
    kind: str
    value: Column | None = None
    before: bool = False


def split_hot(
    df: DataFrame, keys: Sequence[str], rows_per_key: int, sized_by: DataFrame | None = None
) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Rows of keys up to the size, and rows of the larger ones; None for a part that is empty.

    There are at most rows / rows_per_key large keys, which bounds their broadcast. Counting
    reads the key columns only. The third value is the number of rows of the larger keys.
    """
    counted = (df if sized_by is None else sized_by).groupBy(*keys).count()
    large = F.col("count") > rows_per_key
    sizes = counted.agg(
        F.count_if(large).alias("hot"),
        F.count(F.lit(1)).alias("all"),
        F.sum(F.when(large, F.col("count"))).alias("rows"),
    ).first()
    if sizes["hot"] == 0:
        return df, None, 0
    if sizes["hot"] == sizes["all"]:
        return None, df, sizes["rows"]
    hot = pinned(counted.filter(large).select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    is_hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return (
        df.join(F.broadcast(hot), is_hot, "left_anti"),
        df.join(F.broadcast(hot), is_hot, "left_semi"),
        sizes["rows"],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    steps: Sequence[Running],
    max_rows_per_key: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add the running values; `order` must leave no ties within a key.

    `sized_by` is a table that is cheaper to count and has at least as many rows per key.
    """
    cap = max_rows_per_key or limit_setting(df.sparkSession, ROWS_PER_KEY, 2_000_000)
    cold, hot, hot_rows = split_hot(df, keys, cap, sized_by) if keys else (None, df, df.count())
    parts = []
    if cold is not None:
        window = Window.partitionBy(*keys).orderBy(*order)
        parts.append(cold.withColumns({s.name: _in_window(s, window) for s in steps}))
    if hot is not None:
        parts.append(_running_blocked(hot, keys, order, steps, -(-hot_rows // cap)))
    return reduce(DataFrame.unionByName, parts)


def _frame(step: Running, window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1 if step.before else Window.currentRow)


def _in_window(step: Running, window) -> Column:
    if step.kind == "previous":
        return F.lag(step.value).over(window)
    if step.kind == "count":
        return F.count(F.lit(1)).over(_frame(step, window))
    if step.kind == "last":
        return F.last(step.value, ignorenulls=True).over(_frame(step, window))
    return getattr(F, step.kind)(step.value).over(_frame(step, window))


def _block_total(step: Running, position: Column) -> Column:
    """The step over a whole block, as an aggregate that combines before the shuffle."""
    if step.kind == "count":
        return F.count(F.lit(1))
    if step.kind == "last":
        return F.max_by(step.value, F.when(step.value.isNotNull(), position))
    if step.kind == "previous":
        return F.max_by(F.struct(step.value.alias("v")), position)
    return getattr(F, step.kind)(step.value)


def _before_block(step: Running, window) -> Column:
    """Block totals put together over the blocks before this one."""
    total = F.col(f"_total_{step.name}")
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    if step.kind in ("count", "sum"):
        return F.sum(total).over(earlier)
    if step.kind in ("last", "previous"):
        return F.last(total, ignorenulls=True).over(earlier)
    return getattr(F, step.kind)(total).over(earlier)


def _joined(step: Running, local: Column, carry: Column, first_in_block: Column) -> Column:
    if step.kind in ("count", "sum"):
        both = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        known = carry.isNotNull() | local.isNotNull()
        return both if step.kind == "count" else F.when(known, both)
    if step.kind == "last":
        return F.coalesce(local, carry)
    if step.kind == "previous":
        return F.when(first_in_block, carry["v"]).otherwise(local)
    return (F.greatest if step.kind == "max" else F.least)(local, carry)


def _block_count(df: DataFrame, wanted: int) -> int:
    return max(2, limit_setting(df.sparkSession, "spark.sql.shuffle.partitions", 200), wanted)


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: int, most: int | None = None) -> DataFrame:
    """Range-partition by key and order, into at most `most` partitions, and number these in a column."""
    n = _block_count(df, wanted)
    return df.repartitionByRange(min(n, most or n), *keys, *order).withColumn(BLOCK, F.spark_partition_id())


def _of_group(step: Running) -> Column:
    """The step over the blocks of a group, out of their totals."""
    total = F.col(f"_total_{step.name}")
    if step.kind in ("count", "sum"):
        return F.sum(total)
    if step.kind in ("last", "previous"):
        return F.max_by(total, F.when(total.isNotNull(), F.col(BLOCK)))
    return getattr(F, step.kind)(total)


def _added(step: Running, earlier: Column, later: Column) -> Column:
    """What two carries, one behind the other, come to."""
    if step.kind in ("count", "sum"):
        return F.when(earlier.isNotNull() | later.isNotNull(), F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0)))
    if step.kind in ("last", "previous"):
        return F.coalesce(later, earlier)
    return (F.greatest if step.kind == "max" else F.least)(earlier, later)


def _carries(totals: DataFrame, keys: Sequence[str], steps: Sequence[Running], many: bool) -> DataFrame:
    """keys, block and carries of every block that another one of its key comes before."""
    if not many:
        by_key = Window.partitionBy(*keys).orderBy(BLOCK)
        told = totals.withColumn("_earlier", F.lag(BLOCK).over(by_key)).withColumns({f"_carry_{s.name}": _before_block(s, by_key) for s in steps})
        return told.filter(F.col("_earlier").isNotNull())
    grouped = totals.withColumn("_group", F.floor(F.col(BLOCK) / GROUP))
    within = Window.partitionBy(*keys, "_group").orderBy(BLOCK)
    told = grouped.withColumn("_earlier", F.lag(BLOCK).over(within)).withColumns({f"_near_{s.name}": _before_block(s, within) for s in steps})
    groups = grouped.groupBy(*keys, "_group").agg(*[_of_group(s).alias(f"_total_{s.name}") for s in steps])
    by_key = Window.partitionBy(*keys).orderBy("_group")
    far = groups.withColumn("_before", F.lag("_group").over(by_key)).withColumns({f"_far_{s.name}": _before_block(s, by_key) for s in steps})
    far = far.select(F.col("_group").alias("_of"), "_before", *[F.col(k).alias(f"_of_{k}") for k in keys], *[f"_far_{s.name}" for s in steps])
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.col("_group") == F.col("_of"))
    both = told.join(far, same).filter(F.col("_earlier").isNotNull() | F.col("_before").isNotNull())
    return both.withColumns({f"_carry_{s.name}": _added(s, F.col(f"_far_{s.name}"), F.col(f"_near_{s.name}")) for s in steps})


def _running_blocked(df, keys, order, steps, wanted) -> DataFrame:
    columns = df.columns
    named = {f"_value_{s.name}": s.value for s in steps if s.value is not None}
    steps = [
        Running(s.name, s.kind, None if s.value is None else F.col(f"_value_{s.name}"), s.before) for s in steps
    ]
    # Written once, so that both passes below see the same blocks even when executors are lost.
    cut = stored(blocks(df.withColumns(named) if named else df, keys, order, wanted), "blocks")
    position = F.struct(*order)

    n = _block_count(df, wanted)
    totals = cut.groupBy(*keys, BLOCK).agg(*[_block_total(s, position).alias(f"_total_{s.name}") for s in steps])
    carry = _carries(totals, keys, steps, many=n > GROUP).select(
        F.col(BLOCK).alias("_carry_block"),
        *[F.col(k).alias(f"_carry_key_{k}") for k in keys],
        *[f"_carry_{s.name}" for s in steps],
    )
    same = reduce(
        lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_carry_key_{k}")),
        keys,
        F.col(BLOCK) == F.col("_carry_block"),
    )
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = cut.withColumns(
        {f"_local_{s.name}": _in_window(s, in_block) for s in steps}
        | {"_first": F.row_number().over(in_block) == 1}
    )
    # At most one key crosses the start of a block, so `carry` has fewer rows than there are blocks.
    joined = local.join(F.broadcast(carry) if n <= MOST_BROADCAST else carry, same, "left")
    return joined.select(
        *columns,
        *[
            _joined(s, F.col(f"_local_{s.name}"), F.col(f"_carry_{s.name}"), F.col("_first")).alias(s.name)
            for s in steps
        ],
    )
