"""How runs end, told while their lines and exit codes arrive.

Lines and exit codes come on two streams and in any order. The state store keeps, per run, a ring of its last lines, the place of its
first terminal line and its exit code, so that a run costs the same however much it has said. A line that comes late
falls into its place; whichever side comes first, the last row told of a run is that of `operators.runs.run_outcome` and
`failure_tail`. Each batch of lines is thinned out before the shuffle, so that a run that fills it sends a few lines per task.

In a stream that keeps running, a run that has neither ended nor said anything for `silence_ms` is told once more as abandoned and
leaves the state store; what it says later begins anew. Such a stream has always another batch to run, so that the
setting is not for a stream that takes in what is there and stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modelyard.functions import runlog
from modelyard.operators.runs import FAILURE_LINES

TOLD_SCHEMA = (
    "run_id string, version bigint, outcome string, finished boolean, failed boolean, exit_code int, settled boolean, abandoned boolean, "
    "tail array<struct<seq:bigint,line:string>>"
)
HELD_SCHEMA = "version bigint, seqs array<bigint>, lines array<string>, end bigint, finished boolean, failed boolean, exit_code int"


def _last(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    return rows.sort_values(["seq", "line"]).groupby("run_id", dropna=False, sort=False).tail(n)


def _thinned(n: int):
    """Of every run in a batch of rows its last n lines, its first terminal one, and its exit code."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            said = rows[rows["seq"].notna()]
            ends = said[said["finished"] | said["failed"]].sort_values("seq", kind="stable").groupby("run_id", dropna=False, sort=False).head(1)
            kept = said.index.isin(_last(said, n).index) | said.index.isin(ends.index)
            yield rows.loc[[*said.index[kept], *rows[rows["seq"].isna()].drop_duplicates().index]]

    return thin


def _outcome(finished: bool, failed: bool, code: int | None) -> str:
    return "success" if finished or (not failed and code == 0) else "failure"


def follow_outcomes(lines: DataFrame, exit_codes: DataFrame, n: int = FAILURE_LINES, silence_ms: int | None = None) -> DataFrame:
    """What is known of each run after a micro-batch that brought something new of it.

    `lines` has run_id, seq and line, `exit_codes` run_id and exit_code; both are streams. `tail` has the last n lines of a run that
    failed without saying so, else it is empty. `settled` tells that a terminal line or an exit code has come.
    """
    line = F.col("line")
    said = lines.select(
        "run_id", "seq", "line", runlog.is_finished(line).alias("finished"), runlog.is_failed(line).alias("failed"), F.lit(None).cast("int").alias("exit_code")
    ).filter("seq is not null")
    codes = exit_codes.filter("exit_code is not null").select(
        "run_id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("line"), F.lit(False).alias("finished"),
        F.lit(False).alias("failed"), F.col("exit_code").cast("int").alias("exit_code"),
    )
    thin = said.unionByName(codes).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("finished", "failed")})

    def told(key: tuple, held: tuple, abandoned: bool) -> pd.DataFrame:
        version, seqs, texts, end, finished, failed, code = held
        outcome = _outcome(finished, failed, code)
        shown = outcome == "failure" and not failed
        tail = [{"seq": s, "line": t} for s, t in zip(seqs, texts, strict=True)] if shown else []
        settled = end is not None or code is not None
        row = (key[0], version, outcome, finished, failed, code, settled, abandoned, tail)
        names = ["run_id", "version", "outcome", "finished", "failed", "exit_code", "settled", "abandoned", "tail"]
        return pd.DataFrame([row], columns=names).astype({"exit_code": "Int32"})

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            if held[1] and held[3] is None and held[6] is None:
                yield told(key, (held[0] + 1, *held[1:]), True)
            return
        version, seqs, texts, end, finished, failed, code = state.get if state.exists else (0, [], [], None, False, False, None)
        for rows in batches:
            of_line = rows["seq"].notna()
            brought = rows.loc[~of_line, "exit_code"]
            code = int(brought.iloc[-1]) if len(brought) else code
            rows = rows[of_line]
            if not len(rows):
                continue
            ends = rows[rows["finished"] | rows["failed"]]
            if len(ends):
                first = ends.loc[ends["seq"].idxmin()]
                if end is None or first["seq"] < end:
                    end, finished, failed = int(first["seq"]), bool(first["finished"]), bool(first["failed"])
            ring = sorted({*zip(seqs, texts, strict=True), *zip(rows["seq"].astype(int).tolist(), rows["line"].tolist(), strict=True)}, key=lambda x: (x[0], x[1] or ""))
            seqs, texts = [s for s, _ in ring[-n:]], [t for _, t in ring[-n:]]
        held = (version + 1, seqs, texts, end, finished, failed, code)
        state.update(held)
        if silence_ms is not None:
            state.setTimeoutDuration(silence_ms)
        if seqs:  # an exit code waits for the first line of its run
            yield told(key, held, False)

    timeout = GroupStateTimeout.NoTimeout if silence_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return (
        thin.mapInPandas(_thinned(n), thin.schema)
        .groupBy("run_id")
        .applyInPandasWithState(follow, TOLD_SCHEMA, HELD_SCHEMA, "append", timeout)
    )


def last_outcomes(told: DataFrame) -> DataFrame:
    """The newest row of every run out of what the stream has written."""
    columns = [c for c in told.columns if c != "run_id"]
    return told.groupBy("run_id").agg(F.max_by(F.struct(*columns), "version").alias("last")).select("run_id", "last.*")
