"""Lifecycle of projects on a stream: valid moves are accepted, others change nothing.

`follow_stream` follows each micro-batch with the batch operator, which spreads a large
project over tasks, and keeps the states reached per batch. `track_moves` keeps them in the
state store and answers sooner, for batches whose projects each fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modelyard.operators.lifecycle import MOVES, follow_moves
from modelyard.streaming.common import forget_batch


def track_moves(
    events: DataFrame,
    project: str,
    seq: str,
    state: str,
    start: str = "INIT",
    moves: Sequence[tuple[str, str]] = MOVES,
) -> DataFrame:
    """Every event with its verdict and the state after it: `(project, seq, state, accepted, state_after, late)`.

    An event that comes after a later one of its project is told as late, without a verdict, and changes nothing. Ids
    travel as text, so that none is rounded; rows without a project are one project.
    """
    allowed = set(moves)
    types = {c: events.schema[c].dataType.simpleString() for c in (project, seq, state)}
    output = f"_key string, {seq} {types[seq]}, {state} string, accepted boolean, state_after string, late boolean"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        at, last = held.get if held.exists else (start, None)
        rows = pd.concat(list(batches)).sort_values(seq, ignore_index=True)
        late = rows[seq] <= last if last is not None else pd.Series(False, index=rows.index)
        accepted, reached = [], []
        for wanted, behind in zip(rows[state].tolist(), late.tolist(), strict=True):
            ok = None if behind else (at, wanted) in allowed
            at = wanted if ok else at
            accepted.append(ok)
            reached.append(None if behind else at)
        if not late.all():
            held.update((at, int(rows[seq].iloc[-1])))
        yield rows[["_key", seq, state]].assign(accepted=accepted, state_after=reached, late=late)

    return (
        events.select(F.col(project).cast("string").alias("_key"), seq, state)
        .groupBy("_key")
        .applyInPandasWithState(follow, output, "at string, last bigint", "append", GroupStateTimeout.NoTimeout)
        .withColumn(project, F.col("_key").cast(types[project]))
        .select(project, seq, state, "accepted", "state_after", "late")
    )


def moves_schema(events: DataFrame, project: str, seq: str, state: str) -> str:
    """What the sink of `track_moves` holds, and that of `follow_stream` beside the number of the batch."""
    types = {c: events.schema[c].dataType.simpleString() for c in (project, seq, state)}
    return ", ".join(f"{c} {t}" for c, t in types.items()) + ", accepted boolean, state_after string, late boolean"


def follow_stream(
    events: DataFrame,
    project: str,
    seq: str,
    state: str,
    folder: str,
    checkpoint: str,
    start: str = "INIT",
    moves: Sequence[tuple[str, str]] = MOVES,
) -> None:
    """Follow the events that have arrived and stop; verdicts go to `folder`/moves.

    Each micro-batch is judged from the states that the batches before it reached, so an event that comes a batch
    late is judged where it comes in, and told as late. `folder`/states holds all states after the last two batches; a
    batch reads those of the one before. A batch that is run again replaces its own rows.
    """
    types = {c: events.schema[c].dataType.simpleString() for c in (project, seq)}
    reached_schema = f"{project} {types[project]}, last {types[seq]}, reached string"

    def take_in(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, begin, late = batch.select(project, seq, state), F.lit(start), F.lit(False)
        before = None
        if batch_id > 0:
            before = spark.read.schema(reached_schema).parquet(f"{folder}/states/batch={batch_id - 1}")
            known = before.select(F.col(project).alias("_project"), F.col("last").alias("_last"), F.col("reached").alias("_reached"))
            rows = rows.join(known, F.col(project).eqNullSafe(F.col("_project")), "left")
            begin, late = F.coalesce("_reached", F.lit(start)), F.coalesce(F.col(seq) <= F.col("_last"), F.lit(False))
        moved = f"{folder}/moves/batch={batch_id}"
        followed = follow_moves(rows, project, [seq], state, begin, moves)
        verdicts = followed.select(project, seq, state, "accepted", "state_after", late.alias("late"))
        verdicts.write.mode("overwrite").parquet(moved)
        reached = spark.read.schema(verdicts.schema).parquet(moved).groupBy(project).agg(
            F.max(seq).alias("last"), F.max_by("state_after", seq).alias("reached")
        )
        if before is not None:
            now = F.col(project).eqNullSafe(F.col("_project"))
            named = reached.select(F.col(project).alias("_project"), F.col("last").alias("_now"), F.col("reached").alias("_reached"))
            reached = before.join(named, now, "full_outer").select(
                F.coalesce(project, "_project").alias(project),
                F.greatest("last", "_now").alias("last"),
                F.coalesce("_reached", "reached").alias("reached"),
            )
        reached.write.mode("overwrite").parquet(f"{folder}/states/batch={batch_id}")
        forget_batch(spark, f"{folder}/states", batch_id - 2)

    (
        events.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
