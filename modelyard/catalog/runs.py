"""Queries over training runs and lifecycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from modelyard.catalog import fixtures
from modelyard.catalog.fixtures import (
    EVENT_ACTIONS, EVENT_GATES, EVENT_MOVES, EVENT_START, KEPT_SQL, LOG_LINES_SQL, PROGRESS_SQL, log_lines, sql_pairs,
)
from modelyard.catalog.registry import query
from modelyard.functions.runlog import LINE_FIELDS
from modelyard.operators import lifecycle, runs
from modelyard.session import new_folder
from modelyard.sources import states
from modelyard.sources.logs import SCHEMA as RAW_SCHEMA, raw_line_stream, raw_lines
from modelyard.sources.tables import append_states, read_states, table
from modelyard.streaming.common import STATE_BATCH_BYTES, run_available, table_stream
from modelyard.streaming.lifecycle import follow_stream, moves_schema, track_moves
from modelyard.streaming.outcomes import TOLD_SCHEMA, follow_outcomes, last_outcomes
from modelyard.streaming.progress import FIELDS, STATE_SCHEMA, fold_stream, folded_progress, follow_progress, last_progress

FIELD_SQL = ", ".join("val_acc AS best_acc" if n == "best_acc" else n for n in LINE_FIELDS)
PROGRESS_COLUMNS = ("run_id", *FIELDS)
FINAL_SQL = PROGRESS_SQL + f"SELECT {', '.join(PROGRESS_COLUMNS)} FROM folded"


def event_lines(spark, sf):
    return log_lines(table(spark, sf, "events"))


def with_code(users):
    """Every third run left with code 0, the others with 1."""
    return users.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("user_id") % 3 == 0, 0).otherwise(1).alias("exit_code"),
    )


def exit_codes(spark, sf):
    return with_code(table(spark, sf, "events").select("user_id").distinct())


@query(f"WITH {LOG_LINES_SQL} SELECT run_id, seq, {FIELD_SQL} FROM log_said")
def log_parse(spark, sf):
    return runs.informative(runs.parse_lines(event_lines(spark, sf)))


@query(FINAL_SQL)
def progress_fold(spark, sf):
    return runs.final_progress(event_lines(spark, sf)).select(*PROGRESS_COLUMNS)


@query(FINAL_SQL)
def progress_stream(spark, sf):
    """The same state, folded by a stream."""
    schema = table(spark, sf, "events").schema
    folder = new_folder(spark, "progress")
    fold_stream(log_lines(table_stream(spark, sf, "events", schema)), folder, new_folder(spark, "progress-checkpoint"))
    return folded_progress(spark, folder).select(*PROGRESS_COLUMNS)


@query(FINAL_SQL)
def progress_live(spark, sf):
    """The same state, kept in a state store."""
    schema = table(spark, sf, "events").schema
    stream = follow_progress(log_lines(table_stream(spark, sf, "events", schema, STATE_BATCH_BYTES)))
    sink = new_folder(spark, "progress")
    run_available(stream, sink, new_folder(spark, "progress-checkpoint"))
    return last_progress(spark.read.schema(f"run_id string, {STATE_SCHEMA}").parquet(sink)).select(*PROGRESS_COLUMNS)


def _now(column: str, start: str) -> str:
    return (
        f"COALESCE(last_value({column} IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {start}) AS {column}"
    )


@query(
    f"""WITH {LOG_LINES_SQL}, {KEPT_SQL}
    SELECT run_id, seq, {_now('current_epoch', '0')}, {_now('total_epochs', '0')}, {_now('train_loss', '0.0')},
           {_now('train_acc', '0.0')}, {_now('val_loss', '0.0')}, {_now('val_acc', '0.0')},
           {_now('status', "'Starting...'")}, {_now('last_batch_info', "''")},
           GREATEST(0.0, COALESCE(max(val_acc) OVER (PARTITION BY run_id ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)) AS best_acc,
           finished, failed
    FROM kept"""
)
def progress_by_line(spark, sf):
    return runs.progress_by_line(event_lines(spark, sf))


OUTCOME_SQL = (
    PROGRESS_SQL.rstrip()
    + """, outcomes AS (
  SELECT run_id, failed, CASE WHEN finished THEN 'success' WHEN failed THEN 'failure'
                              WHEN CAST(run_id AS BIGINT) % 3 = 0 THEN 'success' ELSE 'failure' END AS outcome
  FROM folded) """
)


@query(OUTCOME_SQL + "SELECT run_id, outcome FROM outcomes")
def run_outcome(spark, sf):
    ends = runs.run_ends(event_lines(spark, sf))
    return runs.run_outcome(ends, exit_codes(spark, sf)).select("run_id", "outcome")


LINE_NUMBERS_SQL = """line_numbers AS (
  SELECT run_id, event_id * 5 + place AS seq,
         row_number() OVER (PARTITION BY run_id ORDER BY event_id * 5 + place DESC) AS back
  FROM log_events, (SELECT unnest(range(5)) AS place))"""


@query(
    f"{OUTCOME_SQL}, {LINE_NUMBERS_SQL} SELECT run_id, seq FROM line_numbers JOIN outcomes USING (run_id) "
    "WHERE back <= 20 AND outcome = 'failure' AND NOT failed"
)
def failure_tail(spark, sf):
    lines = event_lines(spark, sf)
    outcomes = runs.run_outcome(runs.run_ends(lines), exit_codes(spark, sf))
    return runs.failure_tail(lines, outcomes).select("run_id", "seq")


def live_outcomes(spark, sf):
    """Outcomes told by a stream of lines and one of exit codes; a run's code comes with each of its events."""
    schema = table(spark, sf, "events").schema
    lines = log_lines(table_stream(spark, sf, "events", schema, STATE_BATCH_BYTES))
    codes = with_code(table_stream(spark, sf, "events", schema, STATE_BATCH_BYTES))
    sink = new_folder(spark, "outcomes")
    run_available(follow_outcomes(lines, codes), sink, new_folder(spark, "outcomes-checkpoint"))
    return last_outcomes(spark.read.schema(TOLD_SCHEMA).parquet(sink))


@query(OUTCOME_SQL + "SELECT run_id, outcome FROM outcomes")
def outcome_stream(spark, sf):
    """The same outcomes, on a stream."""
    return live_outcomes(spark, sf).select("run_id", "outcome")


@query(
    f"{OUTCOME_SQL}, {LINE_NUMBERS_SQL} SELECT run_id, seq FROM line_numbers JOIN outcomes USING (run_id) "
    "WHERE back <= 20 AND outcome = 'failure' AND NOT failed"
)
def failure_tail_stream(spark, sf):
    """The same last lines, on a stream."""
    return live_outcomes(spark, sf).select("run_id", F.inline("tail")).select("run_id", "seq")


RAW_LINES_SQL = """
SELECT doc_id, line, CAST(coalesce(sum(strlen(CAST(doc_id AS VARCHAR)) + strlen(line) + 2) OVER (
    PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n
      FROM documents)
"""


def written_logs(spark, sf):
    """A folder of logs in which every document has written its lines, each behind the document's id."""
    folder = new_folder(spark, "logs")
    named = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.concat(F.col("doc_id").cast("string"), F.lit("\t"), line))
    table(spark, sf, "documents").select(F.array_join(named, "\n").alias("value")).write.text(folder)
    return folder


def placed_lines(lines):
    """doc_id, line and the place of the line within what its document has written, by the bytes at which lines begin."""
    parts = lines.select(
        F.substring_index("line", "\t", 1).cast("bigint").alias("doc_id"), F.expr("substring(line, instr(line, '\t') + 1)").alias("line"), "seq"
    )
    first = F.min("seq").over(Window.partitionBy("doc_id"))  # the files are read once
    return parts.filter("doc_id is not null").select("doc_id", "line", (F.col("seq") - first).alias("at"))


@query(RAW_LINES_SQL)
def raw_logs(spark, sf):
    """Lines of raw log files, numbered by the bytes at which they begin, read in splits that begin inside lines."""
    return placed_lines(raw_lines(spark, written_logs(spark, sf), split_bytes=1 << 18))


@query(RAW_LINES_SQL)
def raw_log_stream(spark, sf):
    """The same lines from a stream that follows the files."""
    sink = new_folder(spark, "lines")
    run_available(raw_line_stream(spark, written_logs(spark, sf), split_bytes=1 << 18), sink, new_folder(spark, "lines-checkpoint"))
    return placed_lines(spark.read.schema(RAW_SCHEMA).parquet(sink))


REPLAYED_SQL = (
    f"WITH {LOG_LINES_SQL}, {LINE_NUMBERS_SQL}, recent AS (SELECT s.* FROM log_said s "
    f"JOIN line_numbers USING (run_id, seq) WHERE back <= 50), "
    + KEPT_SQL.replace("log_said", "recent")
    + ", "
    + fixtures.FOLDED_SQL
)


@query(REPLAYED_SQL + f"SELECT {', '.join(PROGRESS_COLUMNS)} FROM folded")
def tail_replay(spark, sf):
    """Progress of each run as its last fifty lines tell it."""
    return runs.replayed_progress(event_lines(spark, sf)).select(*PROGRESS_COLUMNS)


@query(
    """SELECT user_id, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50"""
)
def tail_rows(spark, sf):
    return runs.tail(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 50)


@query(
    """SELECT user_id, seconds, CASE WHEN h > 0 THEN h || 'h ' || m || 'm ' || s || 's' ELSE m || 'm ' || s || 's' END AS elapsed
    FROM (SELECT user_id, seconds, w // 3600 AS h, w // 60 % 60 AS m, w % 60 AS s FROM (
      SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds,
             (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS w
      FROM events GROUP BY user_id))"""
)
def run_elapsed(spark, sf):
    return runs.elapsed(table(spark, sf, "events"), "user_id", "ts")


@query(
    """SELECT user_id, event_id, done, done / 500 AS fraction,
      '[' || repeat('█', least(30 * done // 500, 30)) || repeat('░', greatest(30 - 30 * done // 500, 0)) || '] '
          || CAST(round_even(100 * done / 500, 0) AS BIGINT) || '%' AS bar,
      CASE WHEN h > 0 THEN '~' || h || 'h ' || m || 'm' ELSE '~' || m || 'm ' || s || 's' END AS eta
    FROM (SELECT *, CAST(floor(w / 3600.0) AS BIGINT) AS h, ((CAST(floor(w / 60.0) AS BIGINT) % 60) + 60) % 60 AS m,
                 ((w % 60) + 60) % 60 AS s FROM (
      SELECT user_id, event_id, done, CAST(trunc((now - start) / 1000000 / done * (500 - done)) AS BIGINT) AS w FROM (
        SELECT user_id, event_id, epoch_us(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done,
               min(epoch_us(ts)) OVER (PARTITION BY user_id) AS start FROM events)))"""
)
def run_eta(spark, sf):
    """Events read as finished epochs of a run of 500."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    left = runs.time_left(rows, "user_id", ["ts", "event_id"], "ts", F.lit(500))
    return left.select("user_id", "event_id", "done", "fraction", "bar", "eta")


@query(
    """SELECT run_id, won IS NOT NULL AND (broke IS NULL OR won < broke) AS succeeded,
      CASE WHEN won IS NOT NULL AND (broke IS NULL OR won < broke) THEN won - 1 ELSE 3 END::INT AS retry_count,
      CASE WHEN won IS NOT NULL AND (broke IS NULL OR won < broke) THEN won ELSE COALESCE(broke, n) END::INT AS attempts_made
    FROM (SELECT user_id AS run_id, min(a) FILTER (event_type NOT IN ('error', 'view')) AS won,
                 min(a) FILTER (event_type = 'view') AS broke, max(a) AS n
          FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events)
          WHERE a <= 3 GROUP BY user_id)"""
)
def retry_outcome(spark, sf):
    """Events read as attempts: an error failed, a view met an infrastructure error, the rest worked."""
    first = Window.partitionBy("user_id").orderBy("event_id")
    attempts = (
        table(spark, sf, "events")
        .select("user_id", "event_id", "event_type")
        .withColumn("attempt", F.row_number().over(first))
        .filter(F.col("attempt") <= runs.MAX_ATTEMPTS)
        .select(
            F.col("user_id").alias("run_id"),
            "attempt",
            F.when(F.col("event_type").isin("error", "view"), 1).otherwise(0).alias("exit_code"),
            F.when(F.col("event_type") == "view", "docker.errors.APIError: gone").otherwise("trace").alias("log"),
        )
    )
    return runs.retry_outcome(attempts).drop("error_message")


# ---- lifecycles

MOVES_SQL = f"moves(a, b) AS (VALUES {sql_pairs(EVENT_MOVES)})"


@query(
    f"""WITH {MOVES_SQL}, paired AS (
      SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state
      FROM events)
    SELECT event_id, user_id, event_type, from_state FROM paired
    WHERE from_state IS NOT NULL AND (from_state, event_type) NOT IN (SELECT (a, b) FROM moves)"""
)
def transition_audit(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return lifecycle.transition_audit(rows, "user_id", ["ts", "event_id"], "event_type", EVENT_MOVES).drop("ts")


FOLLOW_SQL = f"""
WITH RECURSIVE {MOVES_SQL}, ranked AS (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (
  SELECT user_id, event_id, event_type, n, ('{EVENT_START}', event_type) IN (SELECT (a, b) FROM moves) AS accepted,
         CASE WHEN ('{EVENT_START}', event_type) IN (SELECT (a, b) FROM moves) THEN event_type ELSE '{EVENT_START}' END AS state_after
  FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.event_id, r.event_type, r.n, m.a IS NOT NULL,
         CASE WHEN m.a IS NOT NULL THEN r.event_type ELSE w.state_after END
  FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.n = w.n + 1
  LEFT JOIN moves m ON m.a = w.state_after AND m.b = r.event_type)
SELECT user_id, event_id, event_type, accepted, state_after FROM walk
"""


@query(FOLLOW_SQL)
def lifecycle_fold(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return lifecycle.follow_moves(rows, "user_id", ["event_id"], "event_type", EVENT_START, EVENT_MOVES)


@query(FOLLOW_SQL)
def lifecycle_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    folder = new_folder(spark, "moves")
    follow_stream(
        table_stream(spark, sf, "events", schema), "user_id", "event_id", "event_type",
        folder, new_folder(spark, "moves-checkpoint"), EVENT_START, EVENT_MOVES,
    )
    written = moves_schema(table(spark, sf, "events"), "user_id", "event_id", "event_type")
    return spark.read.schema(written).parquet(f"{folder}/moves").drop("late", "batch")


@query(FOLLOW_SQL)
def lifecycle_live(spark, sf):
    """The same verdicts with the states kept in a state store."""
    schema = table(spark, sf, "events").schema
    stream = track_moves(
        table_stream(spark, sf, "events", schema, STATE_BATCH_BYTES),
        "user_id", "event_id", "event_type", EVENT_START, EVENT_MOVES,
    )
    sink = new_folder(spark, "moves")
    run_available(stream, sink, new_folder(spark, "moves-checkpoint"))
    return spark.read.schema(stream.schema).parquet(sink).drop("late")


ACTIONS_SQL = " ".join(f"WHEN '{s}' THEN '{a}'" for s, a in EVENT_ACTIONS.items())
CURRENT_SQL = f"""
SELECT user_id, state, CASE state {ACTIONS_SQL} ELSE 'Unknown state' END AS action
FROM (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id)
"""


@query(CURRENT_SQL)
def current_state(spark, sf):
    now = lifecycle.current_state(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")
    return lifecycle.next_action(now, "state", EVENT_ACTIONS)


@query(CURRENT_SQL)
def state_roundtrip(spark, sf):
    """Current states from the state records that the events were written to."""
    path = new_folder(spark, "states")
    append_states(
        table(spark, sf, "events").select(
            F.col("user_id").cast("string").alias("project_id"),
            F.col("event_type").alias("state"),
            F.col("ts").alias("at"),
            F.col("event_id").alias("seq"),
            F.create_map(F.lit("k"), fixtures.event_k().cast("string")).alias("spec"),
        ),
        path,
    )
    now = lifecycle.current_state(read_states(spark, path), "project_id", ["at", "seq"], "state")
    return lifecycle.next_action(now, "state", EVENT_ACTIONS).select(
        F.col("project_id").cast("bigint").alias("user_id"), "state", "action"
    )


@query(CURRENT_SQL)
def state_snapshots(spark, sf):
    """The same current states, from snapshots and the records that came after them."""
    path = new_folder(spark, "states")
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("project_id"), F.col("event_type").alias("state"), F.col("ts").alias("at"),
        F.col("event_id").alias("seq"), F.create_map(F.lit("k"), fixtures.event_k().cast("string")).alias("spec"),
    )
    for part in range(4):
        states.append(rows.filter(F.pmod("seq", F.lit(4)) == part), path)
        if part in (0, 2):
            states.compact(spark, path, keep_records=False)
    found = lifecycle.next_action(states.current(spark, path), "state", EVENT_ACTIONS)
    return found.select(F.col("project_id").cast("bigint").alias("user_id"), "state", "action")


@query(
    f"""WITH current AS (
      SELECT user_id, arg_max(event_type, event_id) AS state, count(*) FILTER (event_type = 'purchase') > 0 AS known
      FROM events GROUP BY user_id)
    SELECT user_id, state, action FROM current JOIN (VALUES {sql_pairs(EVENT_GATES)}) g(action, state) USING (state)
    UNION ALL SELECT user_id, state, 'checkout' FROM current WHERE state = 'view' AND known"""
)
def stage_gate(spark, sf):
    """What each user may do next; one who has bought before may check out from a view."""
    events = table(spark, sf, "events")
    states = events.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"),
        F.bool_or(F.col("event_type") == "purchase").alias("known"),
    )
    return lifecycle.allowed_actions(states, EVENT_GATES, "known", (("checkout", "view"),)).drop("known")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_project(spark, sf):
    return lifecycle.latest(table(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(
    """SELECT c_custkey, 'found' AS verdict FROM customer WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)
    UNION ALL SELECT DISTINCT o_custkey * 2, 'absent' FROM orders
              WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)"""
)
def find_projects(spark, sf):
    wanted = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"))
    found, absent = lifecycle.find_projects(table(spark, sf, "customer").select("c_custkey"), wanted, "c_custkey")
    return found.withColumn("verdict", F.lit("found")).unionByName(absent.withColumn("verdict", F.lit("absent")))
