"""One user holds a third of the events and one conversation a third of the turns; answers stay those of the SQL."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import TABLES, compare, connect

import __spark_entry__ as driver
from modelyard.session import ROWS_PER_KEY

ORDERED = (
    "running_best", "run_eta", "progress_by_line", "transition_audit", "lifecycle_fold", "lifecycle_stream", "conversation_text",
    "ordered_batches",
)
OTHERS = (
    "progress_fold", "progress_stream", "progress_live", "tail_replay", "tail_rows", "failure_tail", "run_outcome", "retry_outcome",
    "current_state", "best_checkpoint", "lifecycle_live", "run_elapsed", "context_assembly",
)


@pytest.fixture(scope="module")
def hot(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    for name in TABLES:
        if name not in ("events", "conversations"):
            (folder / f"{name}.parquet").symlink_to(Path(sf) / f"{name}.parquet")
    con = connect(sf)
    con.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM events)
        TO '{folder}/events.parquet'"""
    )
    con.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN conv_id % 3 = 0 THEN 7 ELSE conv_id END AS conv_id,
                                    CASE WHEN conv_id % 3 = 0 THEN (conv_id + 1) * 100 + turn ELSE turn END AS turn)
                  FROM conversations)
        TO '{folder}/conversations.parquet'"""
    )
    return str(folder)


@pytest.mark.parametrize("name", ORDERED + OTHERS)
def test_same_rows_as_sql(spark, hot, name):
    con = connect(hot)
    # Low enough that the hot key, and some others too, are spread over blocks.
    spark.conf.set(ROWS_PER_KEY, 5)
    try:
        assert compare(spark, con, hot, driver.queries()[name], driver.oracle_sql()[name]) is None
    finally:
        spark.conf.unset(ROWS_PER_KEY)
