"""The network, its gradients, training and scoring; column functions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelyard.functions import vectors
from modelyard.operators import metrics
from modelyard.plans import network as net
from modelyard.plans.training import TrainingSettings, bucket_order, dry_run, epoch_log, train
from modelyard.operators.runs import final_progress
from modelyard.session import is_folder, new_folder
from modelyard.sources import tables


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int").repartition(5)


@pytest.mark.parametrize("sizes", [(0, 4, 3), (4, -1, 3), (4, 4, 2.5), (True, 4, 3)])
def test_sizes_must_be_positive(sizes):
    with pytest.raises(ValueError):
        net.Network(*sizes)


def test_gradient_against_finite_differences():
    shape = net.Network(5, 4, 3)
    p = shape.initial(1)
    draw = np.random.default_rng(2)
    x, y = draw.normal(size=(7, 5)), draw.integers(0, 3, 7)
    _, _, grads = net.gradient_sums(p, x, y)
    flat, got = net.pack(p), net.pack(grads)
    for i in range(flat.size):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        loss = [net.losses_of(net.logits_of(net.unpack(f, p), x), y).sum() for f in (up, down)]
        assert got[i] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-5)


def test_first_adam_step_has_the_size_of_the_rate():
    after = net.Adam(3, 0.1).step(np.zeros(3), np.array([5.0, -2.0, 0.0]))
    assert after == pytest.approx([-0.1, 0.1, 0.0])
    with pytest.raises(ValueError):
        net.optimizer("SGD", 3)


@pytest.mark.parametrize("partitions", [3, 100])
def test_gradient_job_adds_up(points, partitions):
    p = net.Network(6, 4, 4).initial(1)
    n, loss, correct, gradient = net.gradient_job(points.repartition(partitions), p, "features", "label")
    rows = points.collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    want_loss, want_correct, want = net.gradient_sums(p, x, y)
    assert (n, correct) == (400, want_correct)
    assert loss == pytest.approx(want_loss)
    assert np.allclose(gradient, net.pack(want))


def test_score_agrees_with_column_functions(points):
    p = net.Network(6, 4, 4).initial(1)
    scored = net.score(points, p, keep=["id"], label="label")
    z = F.col("logits")
    again = scored.select(
        "*",
        vectors.softmax(z).alias("p"),
        vectors.argmax(z).alias("arg"),
        vectors.cross_entropy(z, F.col("label")).alias("ce"),
        vectors.relative_percent(vectors.softmax(z)).alias("rel"),
        vectors.relu(z).alias("relu"),
    ).collect()
    for r in again:
        assert r["prediction"] == r["arg"]
        assert r["confidence"] == pytest.approx(max(r["p"]))
        assert r["probabilities"] == pytest.approx(r["p"], abs=6e-5)
        assert r["loss"] == pytest.approx(r["ce"])
        assert max(r["rel"]) == pytest.approx(100)
        assert r["relu"] == [max(v, 0.0) for v in r["logits"]]


def test_wrong_width_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0)], "features array<double>, label int")
    with pytest.raises(Exception, match="must hold 6 numbers"):
        net.gradient_job(df, net.Network(6, 4, 4).initial(), "features", "label")


@pytest.mark.parametrize("label", [None, -1, 4])
def test_wrong_label_is_an_error(spark, label):
    df = spark.createDataFrame([([1.0, 2.0], label)], "features array<double>, label int")
    with pytest.raises(Exception, match="class from 0 to 3"):
        net.gradient_job(df, net.Network(2, 4, 4).initial(), "features", "label")


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    assert df.select(vectors.argmax(F.col("v"))).first()[0] == 1


def test_preprocess(spark):
    df = spark.createDataFrame([([[[0, 255], [51, 102]]],)], "g array<array<array<int>>>")
    got = df.select(vectors.preprocess(F.col("g"))).first()[0]
    assert got == pytest.approx([(v / 255 - 0.1307) / 0.3081 for v in (0, 255, 51, 102)])
    assert df.select(vectors.has_content(vectors.flatten_grid(F.col("g")))).first()[0]


def test_blank_canvas(spark):
    df = spark.createDataFrame([([255, 255, 255, 10] * 2,), ([0, 0, 0, 10, 0, 0, 0, 11],)], "px array<int>")
    assert [r[0] for r in df.select(vectors.has_content(vectors.alpha_values(F.col("px")))).collect()] == [False, True]


def test_training_learns_and_keeps_checkpoints(spark, points):
    path = new_folder(spark, "checkpoints")
    settings = TrainingSettings(epochs=6, steps_per_epoch=3, learning_rate=0.05, checkpoint_path=path, run_id="r1")
    run = train(points, "id", "features", "label", net.Network(6, 12, 4), settings)
    losses = [m[3] for m in run.metrics if m[2] == "training"]
    assert losses[-1] < 0.7 * losses[0]
    assert run.best_accuracy == max(m[4] for m in run.metrics if m[2] == "validation")
    checkpoints = tables.read_checkpoints(spark, path, "r1")
    assert checkpoints.select("epoch").distinct().count() == 6
    assert tables.best_or_last_epoch(checkpoints) == run.best_epoch
    last = tables.load_parameters(checkpoints, 6)
    assert all(np.array_equal(last[n], run.parameters[n]) for n in ("w1", "b1", "w2", "b2"))
    progress = final_progress(epoch_log(run.epochs(spark))).first()
    assert progress["finished"] and progress["current_epoch"] == 6
    assert progress["best_acc"] == pytest.approx(run.best_accuracy, abs=6e-5)


def test_small_batches_learn_faster_and_do_not_depend_on_the_layout(spark, points):
    shape = net.Network(6, 12, 4)

    def losses(table, **more):
        settings = TrainingSettings(epochs=5, steps_per_epoch=3, learning_rate=0.01, **more)
        run = train(table, "id", "features", "label", shape, settings)
        return [m[3] for m in run.metrics if m[2] == "training"], net.pack(run.parameters)

    by_bucket, _ = losses(points)
    small, parameters = losses(points, batch_size=16)
    again, same = losses(points.repartition(2), batch_size=16)
    assert small[-1] < by_bucket[-1] and small == again and np.array_equal(parameters, same)


def test_one_bucket_of_small_batches_is_plain_training(spark, points):
    shape = net.Network(6, 5, 4)
    rows = sorted(points.collect(), key=lambda r: r["id"])
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    now, adam = shape.initial(1), net.Adam(net.pack(shape.initial(1)).size, 0.01)
    for first in range(0, 400, 64):
        part = slice(first, first + 64)
        _, _, grads = net.gradient_sums(now, x[part], y[part])
        now = net.unpack(adam.step(net.pack(now), net.pack(grads) / len(y[part])), now)
    ordered = points.withColumn("bucket", F.lit(0)).coalesce(1).sortWithinPartitions("id")
    other = net.Adam(adam.m.size, 0.01)
    n, _, _, flat = net.local_round(ordered, shape.initial(1), other, "features", "label", 64)
    assert n == 400 and other.steps == 7 and np.allclose(flat, net.pack(now)) and np.allclose(other.v, adam.v)


def test_a_shorter_run_forgets_the_epochs_of_a_longer_one(spark, points):
    path = new_folder(spark, "checkpoints")
    for epochs, name in ((3, "a"), (2, "b"), (1, "a")):
        settings = TrainingSettings(epochs=epochs, steps_per_epoch=1, checkpoint_path=path, run_id=name)
        train(points, "id", "features", "label", net.Network(6, 4, 4), settings)
    kept = {name: tables.read_checkpoints(spark, path, name).select("epoch").distinct().count() for name in "ab"}
    assert kept == {"a": 1, "b": 2}


class Stop(Exception):
    pass


@pytest.mark.parametrize("more", [{}, {"batch_size": 32}])
@pytest.mark.parametrize("cut", [1, 3, 5])
def test_a_resumed_run_ends_like_one_that_was_not_cut_off(spark, points, more, cut):
    path, shape, begun = new_folder(spark, "checkpoints"), net.Network(6, 8, 4), []

    def run(name, epochs=5, resume=False, stop=None):
        def after(epoch):
            begun.append((name, resume, epoch))
            if epoch == stop:
                raise Stop

        settings = TrainingSettings(epochs, 2, 0.02, run_id=name, checkpoint_path=path, resume=resume, **more)
        return train(points, "id", "features", "label", shape, settings, after)

    whole = run("whole")
    with pytest.raises(Stop):
        run("cut", stop=cut)
    staged = tables.read_mark(spark, path, cut, "cut")["staged"]
    # The epoch behind the last mark has written its parameters, but no mark: the lost driver was not done with it.
    tables.write_checkpoint(spark, path, cut + 1, {**whole.parameters, "adam_m": np.zeros(1)}, 1.0, 1.0, "cut")
    assert tables.marked_epochs(spark, path, "cut") == list(range(1, cut + 1))
    assert {r[0] for r in tables.read_checkpoints(spark, path, "cut").select("epoch").collect()} == set(range(1, cut + 1))
    resumed = run("cut", resume=True)
    assert [e for name, resume, e in begun if resume] == list(range(cut + 1, 6))
    assert [m[1:] for m in resumed.metrics] == [m[1:] for m in whole.metrics]
    assert all(np.array_equal(resumed.parameters[n], whole.parameters[n]) for n in whole.parameters)
    assert (resumed.best_epoch, resumed.best_accuracy) == (whole.best_epoch, whole.best_accuracy)
    assert not is_folder(spark, staged)
    further, longer = run("cut", epochs=6, resume=True), run("longer", epochs=6)
    assert [m[1:] for m in further.metrics][:10] == [m[1:] for m in longer.metrics][:10] and len(further.metrics) == 12


def test_resume_begins_anew_without_marks_and_refuses_other_settings(spark, points):
    path = new_folder(spark, "checkpoints")

    def run(rate, resume=True):
        settings = TrainingSettings(2, 2, rate, checkpoint_path=path, resume=resume)
        return train(points, "id", "features", "label", net.Network(6, 4, 4), settings)

    tables.write_checkpoint(spark, path, 7, {"w1": np.ones((2, 2))}, 1.0, 1.0)
    first = run(0.01)
    assert tables.marked_epochs(spark, path) == [1, 2] and len(first.metrics) == 4
    with pytest.raises(ValueError, match="other settings"):
        run(0.02)
    assert len(run(0.02, resume=False).metrics) == 4


def test_mean_loss_does_not_depend_on_the_layout(spark, points):
    p = net.Network(6, 4, 4).initial(1)
    means = {net.evaluated(points.repartition(n, "id"), p).first()["loss"] for n in (1, 3, 8, 40) for _ in range(2)}
    assert len(means) == 1
    wild = {name: value * 1e300 for name, value in p.items()}
    assert math.isnan(net.evaluated(points, wild).first()["loss"])


def test_evaluated_agrees_with_scored_rows(points):
    p = net.Network(6, 4, 4).initial(1)
    table = points.withColumn("part", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    want = {r["part"]: r for r in metrics.evaluate(net.score(table, p, keep=["part"], label="label"), "part").collect()}
    got = {r["part"]: r for r in net.evaluated(table, p, by="part").collect()}
    assert set(got) == set(want) == {None, 1, 2}
    for part, row in want.items():
        assert (got[part]["n"], got[part]["accuracy"]) == (row["n"], pytest.approx(row["accuracy"]))
        assert got[part]["loss"] == pytest.approx(row["loss"])
    none = net.evaluated(table.filter("id < 0"), p).first()
    assert (none["n"], none["loss"], none["accuracy"]) == (0, None, None)


def test_bad_rows_are_flagged(spark):
    p = net.Network(3, 4, 2).initial(1)
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, None, 1), (3, [1.0], 1), (4, [1.0, None, 2.0], 0), (5, [1.0, math.nan, 2.0], 0), (6, [0.0, 0.0, 1.0], 7), (7, [0.0, 1.0, 1.0], None)]
    table = spark.createDataFrame(rows, "id bigint, features array<double>, label int").coalesce(1)
    got = {r["id"]: r for r in net.score(table, p, keep=["id"], label="label").collect()}
    assert {i for i, r in got.items() if r["bad"]} == {2, 3, 4, 5}
    assert all(got[i]["prediction"] is None and got[i]["logits"] is None and got[i]["loss"] is None for i in (2, 3, 4, 5))
    assert got[6]["prediction"] is not None and got[6]["loss"] is None and got[7]["loss"] is None and got[1]["loss"] > 0
    assert net.score(table.filter("id in (2, 3)"), p, keep=["id"]).filter("bad").count() == 2


def test_last_epoch_when_none_scored(spark):
    path = new_folder(spark, "checkpoints")
    for epoch in (1, 2):
        tables.write_checkpoint(spark, path, epoch, {"w": np.ones((2, 2)) * epoch}, 0.0, 0.0)
    checkpoints = tables.read_checkpoints(spark, path)
    assert tables.best_or_last_epoch(checkpoints) == 2
    assert tables.load_parameters(checkpoints, 2)["w"].tolist() == [[2.0, 2.0], [2.0, 2.0]]


def test_bucket_order():
    assert sorted(bucket_order(1, 8, 42)) == list(range(8))
    assert len({tuple(bucket_order(e, 8, 42)) for e in range(10)}) > 1


def test_dry_run(spark, points):
    good = dry_run(points, "id", "features", "label", net.Network(6, 4, 4))
    assert good["succeeded"] and math.isfinite(good["loss"])
    bad = dry_run(points, "id", "features", "label", net.Network(5, 4, 4))
    assert not bad["succeeded"] and bad["error"]
    poisoned = points.withColumn("features", F.transform("features", lambda v: F.lit(float("nan"))))
    assert not dry_run(poisoned, "id", "features", "label", net.Network(6, 4, 4))["forward"]
