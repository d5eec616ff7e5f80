"""Queries over features and models: preprocessing, scoring, metrics, training."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from modelyard.catalog.fixtures import CLASSES, HIDDEN, SCORED_SQL, fixed_parameters
from modelyard.catalog.registry import query
from modelyard.functions import vectors
from modelyard.operators import metrics
from modelyard.operators.splits import train_test_split
from modelyard.plans.network import Network, evaluated, gradient_job, optimizer, pack, score, unpack
from modelyard.plans.training import TrainingSettings, dry_run as try_out, epoch_log, train
from modelyard.operators.runs import final_progress
from modelyard.session import new_folder
from modelyard.sources.tables import best_or_last_epoch, load_parameters, marked_epochs, read_checkpoints, table, write_checkpoint
from modelyard.streaming.common import run_available, table_stream


def scored_embeddings(spark, sf):
    rows = table(spark, sf, "embeddings")
    return score(rows, fixed_parameters(), "embedding", keep=["vec_id"], label="label")


@query(
    """SELECT event_id, round(value / 500, 6) AS scaled, round((value / 500 - 0.1307::DOUBLE) / 0.3081::DOUBLE, 6) AS standardized
    FROM events"""
)
def standardize(spark, sf):
    scaled = vectors.scale(F.col("value"), 500)
    return table(spark, sf, "events").select(
        "event_id", F.round(scaled, 6).alias("scaled"), F.round(vectors.standardize(scaled), 6).alias("standardized")
    )


@query(
    """SELECT vec_id, len(embedding) AS n,
           round(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) / 255 - 0.1307::DOUBLE) / 0.3081::DOUBLE)), 6) AS total
    FROM embeddings"""
)
def flatten_grid(spark, sf):
    """Embeddings folded to 1 x 8 x 8 and run through the preprocessing chain."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, F.lit(8)))
    chain = vectors.preprocess(F.col("grid"))
    return (
        table(spark, sf, "embeddings")
        .select("vec_id", F.array(rows).alias("grid"))
        .select("vec_id", chain.alias("v"))
        .select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(vectors.total(F.col("v")), 6).alias("total"))
    )


@query(SCORED_SQL + "SELECT vec_id, unnest(range(10)) AS class, round(unnest(z), 4) AS logit FROM logits")
def dense_logits(spark, sf):
    return scored_embeddings(spark, sf).select(
        "vec_id", F.posexplode("logits").alias("class", "logit")
    ).select("vec_id", F.col("class").cast("bigint").alias("class"), F.round("logit", 4).alias("logit"))


SCORE_SQL = SCORED_SQL + "SELECT vec_id, prediction::INT AS prediction, round(confidence, 4) AS confidence FROM rows_scored"


@query(SCORE_SQL)
def score_rows(spark, sf):
    return scored_embeddings(spark, sf).select("vec_id", "prediction", F.round("confidence", 4).alias("confidence"))


@query(SCORE_SQL)
def score_stream(spark, sf):
    """The same scores from a stream of the embeddings."""
    schema = table(spark, sf, "embeddings").schema
    stream = score(table_stream(spark, sf, "embeddings", schema), fixed_parameters(), "embedding", keep=["vec_id"])
    sink = new_folder(spark, "scores")
    run_available(stream, sink, new_folder(spark, "scores-checkpoint"))
    return spark.read.schema(stream.schema).parquet(sink).select("vec_id", "prediction", F.round("confidence", 4).alias("confidence"))


@query(
    SCORED_SQL
    + """SELECT vec_id, unnest(range(10)) AS class, round(unnest(p), 4) AS probability,
           round(unnest(list_transform(p, lambda x: x / list_max(p) * 100)), 3) AS relative, prediction::INT AS prediction,
           round(confidence, 4) AS confidence, round(loss, 6) AS loss FROM rows_scored"""
)
def class_probabilities(spark, sf):
    """Softmax, argmax, share of the largest and loss as column functions on the logits."""
    z, p = F.col("logits"), F.col("p")
    return (
        scored_embeddings(spark, sf)
        .select("vec_id", "label", "logits", vectors.softmax(z).alias("p"))
        .select(
            "vec_id",
            F.posexplode(F.arrays_zip(vectors.rounded(p).alias("p"), vectors.relative_percent(p).alias("r"))).alias("class", "at"),
            vectors.argmax(p).alias("prediction"),
            F.round(F.array_max(p), 4).alias("confidence"),
            F.round(vectors.cross_entropy(z, F.col("label")), 6).alias("loss"),
        )
        .select(
            "vec_id",
            F.col("class").cast("bigint").alias("class"),
            F.col("at.p").alias("probability"),
            F.round("at.r", 3).alias("relative"),
            "prediction",
            "confidence",
            "loss",
        )
    )


@query(SCORED_SQL + "SELECT label, count(*) AS n, round(avg(loss), 6) AS loss FROM rows_scored GROUP BY label")
def cross_entropy(spark, sf):
    return metrics.evaluate(scored_embeddings(spark, sf), "label").select("label", "n", F.round("loss", 6).alias("loss"))


@query(
    SCORED_SQL
    + """SELECT CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 8
                     THEN 'train' ELSE 'test' END AS split,
           count(*) AS n, round(avg(loss), 6) AS loss, round(avg((prediction = label)::INT), 6) AS accuracy
    FROM rows_scored GROUP BY split"""
)
def eval_metrics(spark, sf):
    split = train_test_split(table(spark, sf, "embeddings"), "vec_id")
    return evaluated(split, fixed_parameters(), "embedding", "label", "split").select(
        "split", "n", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy")
    )


@query(
    """SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean
    FROM lineitem GROUP BY l_returnflag"""
)
def weighted_mean(spark, sf):
    mean = metrics.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(mean, 4).alias("mean"))


@query(
    """SELECT event_id, user_id, value, GREATEST(value, before) AS best, value > before AS is_best FROM (
      SELECT event_id, user_id, value, GREATEST(0.0, COALESCE(max(value) OVER (
        PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS before
      FROM events)"""
)
def running_best(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return metrics.running_best(rows, ["user_id"], ["ts", "event_id"], "value").drop("ts")


@query(
    """SELECT user_id, event_id, value FROM events WHERE value > 0
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) = 1"""
)
def best_checkpoint(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return metrics.best_epoch(rows, ["user_id"], "value", ["ts", "event_id"]).drop("ts")


@query(
    """SELECT vec_id, list_count(list_filter(embedding, lambda x: x > 0.25::FLOAT)) AS above FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x > 0.25::FLOAT)) > 0"""
)
def nonblank_inputs(spark, sf):
    level = F.lit(0.25).cast("float")
    rows = table(spark, sf, "embeddings").filter(vectors.has_content(F.col("embedding"), level))
    return rows.select("vec_id", F.size(F.filter("embedding", lambda x: x > level)).cast("bigint").alias("above"))


@query(
    SCORED_SQL.rstrip()
    + f""", gradients AS (
      SELECT 'b2' AS name, i AS "index", avg(p[i + 1] - (label = i)::INT) AS g, (3 * i % 7 - 3) / 64.0 AS bias
      FROM rows_scored, (SELECT unnest(range({CLASSES})) AS i) GROUP BY i
      UNION ALL
      SELECT 'b1', i, avg(CASE WHEN h[i + 1] > 0 THEN list_sum(list_transform(range({CLASSES}), lambda c:
               (p[c + 1] - (r.label = c)::INT) * (((31 * c + 17 * i) % 13 - 6) / 4.0))) ELSE 0 END),
             (7 * i % 5 - 2) / 64.0
      FROM rows_scored r JOIN hidden USING (vec_id), (SELECT unnest(range({HIDDEN})) AS i) GROUP BY i
      UNION ALL
      SELECT 'w2', i, avg((p[i + 1] - (r.label = i)::INT) * list_sum(h)), NULL
      FROM rows_scored r JOIN hidden USING (vec_id), (SELECT unnest(range({CLASSES})) AS i) GROUP BY i
      UNION ALL
      SELECT 'w1', i, avg(CASE WHEN h[i + 1] > 0 THEN list_sum(list_transform(range({CLASSES}), lambda c:
               (p[c + 1] - (r.label = c)::INT) * (((31 * c + 17 * i) % 13 - 6) / 4.0))) ELSE 0 END * inputs), NULL
      FROM rows_scored r JOIN hidden USING (vec_id)
      JOIN (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS inputs FROM embeddings) USING (vec_id),
           (SELECT unnest(range({HIDDEN})) AS i) GROUP BY i),
    once AS (SELECT *, bias - 0.001::DOUBLE * g / (abs(g) + 0.00000001::DOUBLE) AS one FROM gradients)
    SELECT name, "index", round(g, 6) AS gradient, round(one, 6) AS after,
           round(one - 0.001::DOUBLE * (0.9 * 0.1 * g - 0.1 * g / 2) / (1 - 0.9 * 0.9)
             / (sqrt((0.999 * 0.001 * g * g + 0.001 * g * g / 4) / (1 - 0.999 * 0.999)) + 0.00000001::DOUBLE), 6) AS after_two
    FROM once"""
)
def training_step(spark, sf):
    """Mean gradient over the whole table, of the weights as sums by row, and the biases after two updates.

    The second update takes half the gradient back, so that the decay and the correction of both moments count.
    """
    parameters = fixed_parameters()
    n, _, _, total = gradient_job(table(spark, sf, "embeddings"), parameters, "embedding", "label")
    flat = pack(parameters)
    gradient = unpack(total / n, parameters)
    adam = optimizer("Adam", flat.size)
    first = adam.step(flat, total / n)
    after, after_two = unpack(first, parameters), unpack(adam.step(first, -total / n / 2), parameters)
    rows = [
        (name, i, round(float(gradient[name][i]), 6), round(float(after[name][i]), 6), round(float(after_two[name][i]), 6))
        for name in ("b1", "b2")
        for i in range(len(gradient[name]))
    ]
    rows += [(name, i, round(float(row.sum()), 6), None, None) for name in ("w1", "w2") for i, row in enumerate(gradient[name])]
    return spark.createDataFrame(rows, "name string, index bigint, gradient double, after double, after_two double")


NETWORK = Network(64, 48, 10)


SPLIT_SQL = """
  SELECT CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 8
              THEN 'training' ELSE 'validation' END AS phase, count(*) AS n FROM embeddings GROUP BY phase
"""


@query(
    f"""SELECT 'run' AS run_id, CAST(epoch AS INT) AS epoch, phase, n, true AS plausible, true AS learned, true AS found_best
    FROM ({SPLIT_SQL}), (SELECT unnest(range(1, 6)) AS epoch)"""
)
def train_run(spark, sf):
    """Epochs of a run and the rows each phase saw: are losses and accuracies plausible, did the training loss fall, and
    do the checkpoints that were read back name the epoch with the best validation accuracy."""
    path = new_folder(spark, "checkpoints")
    settings = TrainingSettings(epochs=5, steps_per_epoch=4, learning_rate=0.01, checkpoint_path=path)
    rows = table(spark, sf, "embeddings")
    run = train(rows, "vec_id", "embedding", "label", NETWORK, settings)
    best = best_or_last_epoch(read_checkpoints(spark, path))
    accuracies = {epoch: accuracy for _, epoch, phase, _, accuracy in run.metrics if phase == "validation"}
    found_best = best == max(accuracies, key=lambda e: (accuracies[e], -e))
    first, last = (next(m[3] for m in run.metrics if m[1] == e and m[2] == "training") for e in (1, settings.epochs))
    phase = F.when(F.col("split") == "train", "training").otherwise("validation")
    seen = train_test_split(rows, "vec_id").groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    plausible = F.col("loss").between(0.0, 20.0) & F.col("accuracy").between(0.0, 1.0)
    return run.epochs(spark).join(seen, "phase").select(
        "run_id", "epoch", "phase", "n", plausible.alias("plausible"), F.lit(last < first).alias("learned"), F.lit(found_best).alias("found_best")
    )


class Stopped(Exception):
    """Stands for the loss of the driver."""


@query(
    f"""SELECT epoch, phase, true AS same, true AS parameters_same, CAST(5 AS BIGINT) AS marked
    FROM (SELECT DISTINCT phase FROM ({SPLIT_SQL})),
         (SELECT unnest(range(1, 6)) AS epoch)"""
)
def resumed_run(spark, sf):
    """A run that is cut off behind its third epoch, with its fourth half written, and goes on: bit by bit the epochs and parameters
    of a run that nothing interrupts."""
    path = new_folder(spark, "checkpoints")
    rows = table(spark, sf, "embeddings")

    def run(name, resume=False, after_epoch=None):
        settings = TrainingSettings(5, 2, 0.01, run_id=name, checkpoint_path=path, resume=resume)
        return train(rows, "vec_id", "embedding", "label", NETWORK, settings, after_epoch)

    def stop(epoch):
        if epoch == 3:
            raise Stopped

    whole = run("whole")
    try:
        run("cut", after_epoch=stop)
    except Stopped:
        half = {name: value + 1 for name, value in load_parameters(read_checkpoints(spark, path, "cut"), 3).items()}
        write_checkpoint(spark, path, 4, half, 1.0, 1.0, "cut")
    resumed = run("cut", resume=True)
    same = all(np.array_equal(whole.parameters[name], resumed.parameters[name]) for name in whole.parameters)
    both = whole.epochs(spark).join(resumed.epochs(spark).select("epoch", "phase", F.struct("loss", "accuracy").alias("told")), ["epoch", "phase"], "full")
    marked = len(marked_epochs(spark, path, "cut"))
    return both.select(
        F.col("epoch").cast("bigint"), "phase", F.col("told").eqNullSafe(F.struct("loss", "accuracy")).alias("same"), F.lit(same).alias("parameters_same"),
        F.lit(marked).cast("bigint").alias("marked"),
    )


@query("SELECT vec_id, true AS a_class, true AS sure, true AS whole, false AS bad FROM embeddings")
def trained_scores(spark, sf):
    """Every row scored with the best checkpoint of a short run: is the prediction a class and its confidence its share."""
    path = new_folder(spark, "checkpoints")
    rows = table(spark, sf, "embeddings")
    train(rows, "vec_id", "embedding", "label", NETWORK,
          TrainingSettings(epochs=2, steps_per_epoch=2, learning_rate=0.01, checkpoint_path=path))
    checkpoints = read_checkpoints(spark, path)
    parameters = load_parameters(checkpoints, best_or_last_epoch(checkpoints))
    shares = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    share = F.get("probabilities", F.col("prediction"))
    return score(rows, parameters, "embedding", keep=["vec_id"]).select(
        "vec_id",
        F.col("prediction").between(0, 9).alias("a_class"),
        ((F.abs(share - F.col("confidence")) < 0.0001) & (F.array_max("probabilities") == share)).alias("sure"),
        (F.abs(shares - 1) < 0.001).alias("whole"),
        "bad",
    )


@query(
    f"""SELECT 'run' AS run_id, CAST(2 AS BIGINT) AS current_epoch, CAST(2 AS BIGINT) AS total_epochs, 'Training complete!' AS status,
           true AS finished, false AS failed, '' AS last_batch_info, count(*) = 2 AS same_numbers FROM ({SPLIT_SQL})"""
)
def training_log(spark, sf):
    """The log a run writes, read back into its final progress."""
    run = train(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", NETWORK,
                TrainingSettings(epochs=2, steps_per_epoch=2, learning_rate=0.01))
    last = {phase: (loss, accuracy) for _, epoch, phase, loss, accuracy in run.metrics if epoch == 2}
    told = {"train_loss": last["training"][0], "train_acc": last["training"][1], "val_loss": last["validation"][0],
            "val_acc": last["validation"][1], "best_acc": run.best_accuracy}
    same = [F.abs(F.col(name) - value) <= 0.00006 for name, value in told.items()]
    return final_progress(epoch_log(run.epochs(spark))).select(
        "run_id", "current_epoch", "total_epochs", "status", "finished", "failed", "last_batch_info",
        reduce(lambda a, b: a & b, same).alias("same_numbers"),
    )


@query(
    """SELECT true AS succeeded, true AS forward, true AS backward, true AS stepped, true AS plausible, CAST(NULL AS VARCHAR) AS error
    FROM embeddings HAVING count(*) > 0
    UNION ALL SELECT false, false, false, false, false, 'wrong width' FROM embeddings HAVING count(*) > 0"""
)
def dry_run(spark, sf):
    """Flags of two batches, once as it should be and once with a network of another input size."""
    rows = table(spark, sf, "embeddings")
    good = try_out(rows, "vec_id", "embedding", "label", NETWORK)
    bad = try_out(rows, "vec_id", "embedding", "label", Network(63, 48, 10))
    flags = [
        (r["succeeded"], r["forward"], r["backward"], r["stepped"], 0.0 < r["loss"] < 20.0,
         r["error"] and ("wrong width" if "63 numbers" in r["error"] else r["error"]))
        for r in (good, bad)
    ]
    return spark.createDataFrame(flags, "succeeded boolean, forward boolean, backward boolean, stepped boolean, plausible boolean, error string")
