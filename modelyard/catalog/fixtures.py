"""Inputs the queries derive from the given tables, and the fixed lookups they use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_TYPES = ("signup", "view", "click", "purchase", "error")
EVENT_MOVES = (
    ("signup", "view"),
    ("view", "view"),
    ("view", "click"),
    ("click", "view"),
    ("click", "purchase"),
    ("purchase", "view"),
    *[("error", t) for t in EVENT_TYPES],
    *[(t, "error") for t in EVENT_TYPES if t != "error"],
)
EVENT_START = "view"
EVENT_ACTIONS = {
    "signup": "show the catalog",
    "view": "offer an item",
    "click": "offer the checkout",
    "purchase": "send the goods",
}
EVENT_GATES = (
    ("browse", "view"),
    ("browse", "signup"),
    ("browse", "purchase"),
    ("checkout", "click"),
    ("recover", "error"),
)


def sql_pairs(pairs) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def decimal_text(c: Column) -> Column:
    return c.cast("decimal(12,4)").cast("string")


def log_lines(events: DataFrame) -> DataFrame:
    """Five log lines per event: `(run_id, seq, line)`.

    An event is an epoch of its user's run: header, batch, training result (with a `nan` loss
    in some), validation result (missing in some) and a closing line that may end the run.
    """
    e = events.select("event_id", "user_id", "event_type", "value", event_k().alias("k"))
    epoch = (F.col("event_id") + 1).cast("string")
    total = (F.col("event_id") + 1 + F.col("k")).cast("string")
    k = F.col("k").cast("string")
    kind = F.col("event_type")
    loss, acc = decimal_text(F.col("value") / 100), decimal_text(F.col("k") / 100)
    train_loss = F.when((kind == "error") & (F.col("k") < 50), "nan").otherwise(loss)
    lines = F.array(
        F.concat(F.lit("--- Epoch "), epoch, F.lit("/"), total, F.lit(" ---")),
        F.concat(F.lit("  Batch "), k, F.lit("/938 - Loss: "), loss),
        F.concat(F.lit("Epoch "), epoch, F.lit(" Training - Loss: "), train_loss, F.lit(", Accuracy: "), acc),
        F.when((kind == "view") & (F.col("k") < 30), "Validation skipped").otherwise(
            F.concat(F.lit("Epoch "), epoch, F.lit(" Validation - Loss: "), loss, F.lit(", Accuracy: "), acc)
        ),
        F.when((kind == "purchase") & (F.col("k") >= 95), "Training process finished successfully.")
        .when((kind == "error") & (F.col("k") >= 90), F.concat(F.lit("Training failed: step "), epoch))
        .when((kind == "click") & (F.col("k") >= 98), "  An unhandled Critical Error occurred: bad input ")
        .otherwise("Checkpoint saved"),
    )
    return e.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id"),
        F.posexplode(lines).alias("at", "line"),
    ).select("run_id", (F.col("event_id") * 5 + F.col("at")).alias("seq"), "line")


# The same lines as field values, one row per event, for the SQL of the log queries.
LOG_EVENTS_SQL = """
e AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, event_type,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, event_id + 1 AS i
  FROM events),
log_events AS (
  SELECT *, i + k AS n,
         CAST(value / 100 AS DECIMAL(12,4)) AS loss_d,
         CAST(CAST(value / 100 AS DECIMAL(12,4)) AS DOUBLE) AS loss,
         CAST(CAST(k / 100 AS DECIMAL(12,4)) AS DOUBLE) AS acc,
         NOT (event_type = 'error' AND k < 50) AS trained,
         NOT (event_type = 'view' AND k < 30) AS validated,
         event_type = 'purchase' AND k >= 95 AS finished,
         (event_type = 'error' AND k >= 90) OR (event_type = 'click' AND k >= 98) AS failed,
         CASE WHEN event_type = 'error' THEN 'Training failed: step ' || i
              ELSE 'An unhandled Critical Error occurred: bad input' END AS failure
  FROM e)
"""

LOG_LINES_SQL = LOG_EVENTS_SQL + """,
log_said AS (
  SELECT run_id, event_id * 5 AS seq, i - 1 AS current_epoch, n AS total_epochs,
         NULL::DOUBLE AS train_loss, NULL::DOUBLE AS train_acc, NULL::DOUBLE AS val_loss, NULL::DOUBLE AS val_acc,
         'Training epoch ' || i || '/' || n AS status, FALSE AS finished, FALSE AS failed,
         NULL::VARCHAR AS error_message, NULL::VARCHAR AS last_batch_info FROM log_events
  UNION ALL
  SELECT run_id, event_id * 5 + 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE, FALSE, NULL,
         'Batch ' || k || '/938 | Loss: ' || loss_d FROM log_events
  UNION ALL
  SELECT run_id, event_id * 5 + 2, i, NULL, loss, acc, NULL, NULL, 'Epoch ' || i || ' — validating...',
         FALSE, FALSE, NULL, NULL FROM log_events WHERE trained
  UNION ALL
  SELECT run_id, event_id * 5 + 3, NULL, NULL, NULL, NULL, loss, acc, 'Epoch ' || i || ' complete',
         FALSE, FALSE, NULL, '' FROM log_events WHERE validated
  UNION ALL
  SELECT run_id, event_id * 5 + 4, NULL, NULL, NULL, NULL, NULL, NULL,
         CASE WHEN failed THEN 'Training failed' ELSE 'Training complete!' END,
         finished, failed, CASE WHEN failed THEN failure END, NULL FROM log_events WHERE finished OR failed)
"""

FOLDED_SQL = """
folded AS (
  SELECT run_id,
         COALESCE(arg_max(current_epoch, seq) FILTER (current_epoch IS NOT NULL), 0) AS current_epoch,
         COALESCE(arg_max(total_epochs, seq) FILTER (total_epochs IS NOT NULL), 0) AS total_epochs,
         COALESCE(arg_max(train_loss, seq) FILTER (train_loss IS NOT NULL), 0.0) AS train_loss,
         COALESCE(arg_max(train_acc, seq) FILTER (train_acc IS NOT NULL), 0.0) AS train_acc,
         COALESCE(arg_max(val_loss, seq) FILTER (val_loss IS NOT NULL), 0.0) AS val_loss,
         COALESCE(arg_max(val_acc, seq) FILTER (val_acc IS NOT NULL), 0.0) AS val_acc,
         GREATEST(COALESCE(max(val_acc), 0.0), 0.0) AS best_acc,
         COALESCE(arg_max(status, seq) FILTER (status IS NOT NULL), 'Starting...') AS status,
         bool_or(finished) AS finished, bool_or(failed) AS failed,
         COALESCE(arg_max(error_message, seq) FILTER (error_message IS NOT NULL), '') AS error_message,
         COALESCE(arg_max(last_batch_info, seq) FILTER (last_batch_info IS NOT NULL), '') AS last_batch_info
  FROM kept GROUP BY run_id)
"""

KEPT_SQL = """
kept AS (
  SELECT s.* FROM log_said s
  LEFT JOIN (SELECT run_id, min(seq) AS stop FROM log_said WHERE finished OR failed GROUP BY run_id) t USING (run_id)
  WHERE stop IS NULL OR seq <= stop)
"""

PROGRESS_SQL = f"WITH {LOG_LINES_SQL}, {KEPT_SQL}, {FOLDED_SQL} "


# ---- a network with weights that are exact in binary

INPUTS, HIDDEN, CLASSES = 64, 16, 10


def fixed_parameters() -> dict[str, np.ndarray]:
    def weights(rows: int, columns: int) -> np.ndarray:
        i, j = np.indices((rows, columns))
        return ((31 * i + 17 * j) % 13 - 6) / 64

    return {
        "w1": weights(HIDDEN, INPUTS),
        "b1": (7 * np.arange(HIDDEN) % 5 - 2) / 64,
        "w2": weights(CLASSES, HIDDEN) * 16,
        "b2": (3 * np.arange(CLASSES) % 7 - 3) / 64,
    }


LOGITS_SQL = f"""
hidden AS (
  SELECT vec_id, label, list_transform(range({HIDDEN}), lambda i: greatest(0.0, (7 * i % 5 - 2) / 64.0 + list_sum(
           list_transform(range({INPUTS}), lambda j:
             CAST(embedding[j + 1] AS DOUBLE) * (((31 * i + 17 * j) % 13 - 6) / 64.0))))) AS h
  FROM embeddings),
logits AS (
  SELECT vec_id, label, list_transform(range({CLASSES}), lambda c: (3 * c % 7 - 3) / 64.0 + list_sum(
           list_transform(range({HIDDEN}), lambda i: h[i + 1] * (((31 * c + 17 * i) % 13 - 6) / 4.0)))) AS z
  FROM hidden),
scored AS (
  SELECT vec_id, label, z, list_max(z) AS top,
         list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS total
  FROM logits),
rows_scored AS (
  SELECT vec_id, label, z, list_transform(z, lambda x: exp(x - top) / total) AS p,
         list_position(z, top) - 1 AS prediction, 1.0 / total AS confidence,
         ln(total) + top - z[label + 1] AS loss
  FROM scored)
"""
SCORED_SQL = f"WITH {LOGITS_SQL} "
