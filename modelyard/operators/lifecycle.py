"""Lifecycle of projects: allowed moves, next actions, current states, audits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelyard.operators.ordered import BLOCK, MOST_BROADCAST as MOST_BLOCKS, Running, blocks, running, split_hot
from modelyard.session import ROWS_PER_KEY, limit_setting, pinned

# The states and the moves between them.
STATES = (
    "INIT", "SCOPING", "SPEC_CONFIRMED", "DATA_REQUIRED", "DATA_VALIDATED", "ENV_BUILDING", "ENV_READY",
    "CODE_GENERATED", "MOCK_RUNNING", "MOCK_PASSED", "TRAINING", "TRAINING_COMPLETE", "INFERENCE_READY", "DONE",
)
MOVES = (
    ("INIT", "SCOPING"),
    ("SCOPING", "SCOPING"),
    ("SCOPING", "SPEC_CONFIRMED"),
    ("SPEC_CONFIRMED", "DATA_REQUIRED"),
    ("DATA_REQUIRED", "DATA_VALIDATED"),
    ("DATA_VALIDATED", "ENV_BUILDING"),
    ("ENV_BUILDING", "ENV_READY"),
    ("ENV_BUILDING", "ENV_BUILDING"),
    ("ENV_READY", "CODE_GENERATED"),
    ("ENV_READY", "ENV_BUILDING"),
    ("ENV_READY", "MOCK_RUNNING"),
    ("CODE_GENERATED", "MOCK_RUNNING"),
    ("CODE_GENERATED", "CODE_GENERATED"),
    ("CODE_GENERATED", "ENV_BUILDING"),
    ("MOCK_RUNNING", "MOCK_PASSED"),
    ("MOCK_RUNNING", "MOCK_RUNNING"),
    ("MOCK_RUNNING", "CODE_GENERATED"),
    ("MOCK_RUNNING", "ENV_BUILDING"),
    ("MOCK_PASSED", "TRAINING"),
    ("TRAINING", "TRAINING_COMPLETE"),
    ("TRAINING", "TRAINING"),
    ("TRAINING_COMPLETE", "INFERENCE_READY"),
    ("INFERENCE_READY", "DONE"),
)

# What comes next in each state.
NEXT_ACTIONS = {
    "INIT": "Start the project",
    "SCOPING": "Continue conversation or confirm specification",
    "SPEC_CONFIRMED": "Review data requirements",
    "DATA_REQUIRED": "Run data validate",
    "DATA_VALIDATED": "Run env build",
    "ENV_BUILDING": "Wait for container build to complete",
    "ENV_READY": "Run generate to generate training code",
    "CODE_GENERATED": "Run mock-run to validate generated code",
    "MOCK_RUNNING": "Wait for mock run to complete",
    "MOCK_PASSED": "Run train",
    "TRAINING": "Wait for training or run attach",
    "TRAINING_COMPLETE": "Review training results",
    "INFERENCE_READY": "Test inference",
    "DONE": "Project complete!",
}
UNKNOWN_ACTION = "Unknown state"

# The states from which each action may start.
GATES = (
    ("validate_data", "DATA_REQUIRED"),
    ("build_environment", "DATA_VALIDATED"),
    ("build_environment", "ENV_BUILDING"),
    ("build_environment", "ENV_READY"),
    ("build_environment", "CODE_GENERATED"),
    ("build_environment", "MOCK_RUNNING"),
    ("generate_code", "ENV_READY"),
    ("generate_code", "CODE_GENERATED"),
    ("generate_code", "MOCK_RUNNING"),
    ("run_mock", "CODE_GENERATED"),
    ("run_mock", "MOCK_RUNNING"),
    ("start_training", "MOCK_PASSED"),
    ("start_training", "TRAINING"),
    ("attach_to_training", "TRAINING"),
)
# Further starts for projects whose code is already there.
GATES_WITH_CODE = (("run_mock", "ENV_READY"),)


def pairs_table(spark: SparkSession, pairs: Sequence[tuple[str, str]], first: str, second: str) -> DataFrame:
    """A small lookup table of fixed pairs."""
    return spark.createDataFrame(list(pairs), f"{first} string, {second} string")


def allowed_move(before: Column, after: Column, moves: Sequence[tuple[str, str]] = MOVES) -> Column:
    """Is (before, after) among the moves; as a literal set, with no join."""
    return F.coalesce(
        F.struct(before.alias("a"), after.alias("b")).isin(
            *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in moves]
        ),
        F.lit(False),
    )


def next_action(df: DataFrame, state: str, actions: dict[str, str] = NEXT_ACTIONS) -> DataFrame:
    """Add `action` by lookup."""
    lookup = pairs_table(df.sparkSession, list(actions.items()), state, "action")
    return df.join(F.broadcast(lookup), state, "left").withColumn(
        "action", F.coalesce("action", F.lit(UNKNOWN_ACTION))
    )


def current_state(df: DataFrame, project: str, order: Sequence[str], state: str) -> DataFrame:
    """Latest state of every project."""
    return df.groupBy(project).agg(F.max_by(F.col(state), F.struct(*order)).alias("state"))


def latest(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The most recently changed row."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(1)


def find_projects(df: DataFrame, wanted: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted projects, and the wanted ids that do not exist."""
    found = df.join(wanted.select(project).distinct(), project, "left_semi")
    absent = wanted.select(project).distinct().join(df.select(project), project, "left_anti")
    return found, absent


def allowed_actions(
    states: DataFrame,
    gates: Sequence[tuple[str, str]] = GATES,
    flag: str | None = None,
    flagged_gates: Sequence[tuple[str, str]] = GATES_WITH_CODE,
) -> DataFrame:
    """Every action each project may start in its current state.

    The flagged gates count only for projects whose flag column is true.
    """
    rows = [(a, s, False) for a, s in gates] + [(a, s, True) for a, s in flagged_gates if flag is not None]
    table = states.sparkSession.createDataFrame(rows, "action string, state string, _needs boolean")
    joined = states.join(F.broadcast(table), "state")
    if flag is not None:
        joined = joined.filter(~F.col("_needs") | F.coalesce(F.col(flag), F.lit(False)))
    return joined.drop("_needs")


def transition_audit(
    df: DataFrame,
    project: str,
    order: Sequence[str],
    state: str,
    moves: Sequence[tuple[str, str]] = MOVES,
    max_rows_per_key: int | None = None,
) -> DataFrame:
    """Moves between consecutive rows of a project that are not allowed."""
    steps = [Running("from_state", "previous", F.col(state))]
    paired = running(df, [project], order, steps, max_rows_per_key)
    return paired.filter(
        F.col("from_state").isNotNull() & ~allowed_move(F.col("from_state"), F.col(state), moves)
    )


# ---- accept or reject each move against the state reached so far

BEGIN, BEGIN_CODE, WANTED_CODE, AFTER_CODE = "_begin", "_begin_code", "_wanted_code", "_after_code"


@dataclass(frozen=True)
class MoveTable:
    """Moves as a table of state numbers; the last number stands for any state that the moves do not name."""

    names: tuple[str, ...]
    allowed: np.ndarray  # [state, wanted]
    after: np.ndarray  # [state, wanted]: the state after it

    @classmethod
    def of(cls, moves: Sequence[tuple[str, str]]) -> MoveTable:
        names = tuple(sorted({n for move in moves for n in move}))
        number = {n: i for i, n in enumerate(names)}
        allowed = np.zeros((len(names) + 1, len(names) + 1), bool)
        for a, b in moves:
            allowed[number[a], number[b]] = True
        states = np.arange(len(names) + 1, dtype=np.int16)
        return cls(names, allowed, np.where(allowed, states[None, :], states[:, None]))

    def code(self, state: Column) -> Column:
        lookup = F.create_map(*[F.lit(x) for i, n in enumerate(self.names) for x in (n, i)])
        return F.coalesce(F.try_element_at(lookup, state), F.lit(len(self.names))).cast("smallint")


def _starts_group(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Where a value differs from the one before it; values are compared as Arrow has them, null equals null."""
    earlier = pa.concat_arrays([pa.array([None if before is None else before.as_py()], column.type), column.slice(0, len(column) - 1)])
    same = pc.fill_null(pc.equal(column, earlier), False)
    same = pc.or_(same, pc.and_(pc.is_null(column), pc.is_null(earlier)))
    first = ~same.to_numpy(zero_copy_only=False)
    if before is None and len(first):
        first[0] = True
    return first


def _chained(first: np.ndarray, wanted: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Per row, where each state would be after all rows of its group up to it; the steps double."""
    maps, closed, step = after.T[wanted], first.copy(), 1
    closed[:1] = True
    while not closed.all():
        open_ = np.flatnonzero(~closed)
        earlier = open_ - step
        maps[open_], closed[open_] = np.take_along_axis(maps[open_], maps[earlier].astype(np.intp), 1), closed[earlier]
        step *= 2
    return maps


def follow_moves(
    df: DataFrame,
    project: str,
    order: Sequence[str],
    state: str,
    start: str | Column = "INIT",
    moves: Sequence[tuple[str, str]] = MOVES,
    max_rows_per_key: int | None = None,
) -> DataFrame:
    """Accept valid moves and reject others without changing the state.

    `start` is the state every project begins in, or a column that holds the one of its own. Rows without a project
    are one project. Rows stream through in order as Arrow batches: states are small numbers, a batch is followed by
    composing the rows' maps from state to state, and all other columns are handed on as they are. When a project
    is too large for one task its rows are spread over blocks: each block first works out where it would end from
    every possible start, those small maps are chained, and then every block is followed from its true start.
    """
    cap = max_rows_per_key or limit_setting(df.sparkSession, ROWS_PER_KEY, 2_000_000)
    table = MoveTable.of(moves)
    begin = start if isinstance(start, Column) else F.lit(start)
    coded = df.withColumn(BEGIN, begin).withColumns({BEGIN_CODE: table.code(F.col(BEGIN)), WANTED_CODE: table.code(F.col(state))})
    cold, hot, hot_rows = split_hot(coded, [project], cap)
    parts = []
    if cold is not None:
        parts.append(_followed(cold.repartition(project).sortWithinPartitions(project, *order), project, table, {}))
    if hot is not None:
        parts.append(_follow_blocked(hot, project, order, table, -(-hot_rows // cap)))
    names = F.array(*[F.lit(n) for n in table.names])
    reached = F.coalesce(F.get(names, F.col(AFTER_CODE)), F.col(BEGIN)).alias("state_after")
    return reduce(DataFrame.unionByName, parts).select(*df.columns, "accepted", reached)


def _followed(rows: DataFrame, project: str, table: MoveTable, carried: dict[int, int]) -> DataFrame:
    """Add `accepted` and the number of the state after each row; rows are sorted by project and order.

    `carried` holds the state in which the first project of a block goes on from the block before.
    """
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField(AFTER_CODE, T.ShortType())]
    )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, None
        for batch in batches:
            if not len(batch):
                continue
            keys, wanted = batch.column(project), batch.column(WANTED_CODE).to_numpy()
            begins = batch.column(BEGIN_CODE).to_numpy().copy()
            first = _starts_group(keys, last)
            if last is None and carried:
                begins[0] = carried.get(batch.column(BLOCK)[0].as_py(), begins[0])
            if not first[0]:
                begins[0] = at
            opens = first.copy()
            opens[0] = True
            group_begin = begins[opens][np.cumsum(opens) - 1]
            reached = np.take_along_axis(_chained(first, wanted, table.after), group_begin[:, None].astype(np.intp), 1)[:, 0]
            before = np.concatenate([group_begin[:1], reached[:-1]])
            before[opens] = group_begin[opens]
            last, at = keys[len(keys) - 1], reached[-1]
            added = [pa.array(table.allowed[before, wanted]), pa.array(reached.astype(np.int16))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return rows.mapInArrow(follow, schema)


def _follow_blocked(df: DataFrame, project: str, order: Sequence[str], table: MoveTable, wanted_blocks: int) -> DataFrame:
    cut = pinned(blocks(df, [project], order, wanted_blocks, MOST_BLOCKS).sortWithinPartitions(project, *order))
    key_type = df.schema[project].dataType.simpleString()
    ends_schema = f"{project} {key_type}, {BLOCK} int, first smallint, ends array<smallint>"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, begin, so_far = None, 0, 0, None

        def told(keys, blocks, begins, maps):
            lists = pa.array([m.tolist() for m in maps], pa.list_(pa.int16()))
            arrays = [keys, pa.array(blocks, pa.int32()), pa.array(begins, pa.int16()), lists]
            return pa.RecordBatch.from_arrays(arrays, names=[project, BLOCK, "first", "ends"])

        for batch in batches:
            if not len(batch):
                continue
            keys, wanted = batch.column(project), batch.column(WANTED_CODE).to_numpy()
            first = _starts_group(keys, last)
            maps = _chained(first, wanted, table.after)
            if not first[0]:  # the group goes on from the batch before
                end = int(np.append(np.flatnonzero(first), len(first))[0])
                maps[:end] = np.take_along_axis(maps[:end], np.broadcast_to(so_far, maps[:end].shape).astype(np.intp), 1)
            elif last is not None:
                yield told(pa.array([last.as_py()], keys.type), [block], [begin], [so_far])
            starts = np.flatnonzero(first)
            ending = starts[1:] - 1 if first[0] else starts - 1
            begins = batch.column(BEGIN_CODE).to_numpy()
            numbers = batch.column(BLOCK).to_numpy()
            group_begin = begins[starts] if first[0] else np.concatenate([[begin], begins[starts]])
            if len(ending):
                yield told(keys.take(pa.array(ending)), numbers[ending], group_begin[:-1], maps[ending])
            last, block, begin, so_far = keys[len(keys) - 1], int(numbers[-1]), int(group_begin[-1]), maps[-1]
        if last is not None:
            yield told(pa.array([last.as_py()], last.type), [block], [begin], [so_far])

    summaries = cut.select(project, BLOCK, WANTED_CODE, BEGIN_CODE).mapInArrow(ends, ends_schema)
    several = summaries.groupBy(project).agg(F.collect_list(F.struct(BLOCK, "first", "ends")).alias("path"))
    # One entry per block boundary that falls inside a project: fewer than there are blocks.
    starts: dict[int, int] = {}
    for row in several.filter(F.size("path") > 1).toLocalIterator():
        path = sorted(row["path"], key=lambda step: step[BLOCK])
        at = path[0]["first"]
        for step, following in zip(path, path[1:]):
            at = step["ends"][at]
            starts[following[BLOCK]] = at
    return _followed(cut, project, table, starts).drop(BLOCK)
