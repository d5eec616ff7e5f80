"""A two-layer ReLU classifier applied to Arrow batches; gradients as sums that add up over tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Parameters = dict[str, np.ndarray]

# Optimizer constants.
LEARNING_RATE = 0.001
BETAS = (0.9, 0.999)
EPSILON = 1e-8


@dataclass(frozen=True)
class Network:
    """Sizes of the layers; every one a positive whole number."""

    input_size: int
    hidden_size: int = 48
    num_classes: int = 10

    def __post_init__(self):
        for size in (self.input_size, self.hidden_size, self.num_classes):
            if not isinstance(size, int) or isinstance(size, bool) or size <= 0:
                raise ValueError("layer sizes must be positive whole numbers")

    def initial(self, seed: int = 42) -> Parameters:
        """Uniform within 1/sqrt(inputs) of each layer."""
        draw = np.random.default_rng(seed)
        first, second = 1 / math.sqrt(self.input_size), 1 / math.sqrt(self.hidden_size)
        return {
            "w1": draw.uniform(-first, first, (self.hidden_size, self.input_size)),
            "b1": draw.uniform(-first, first, self.hidden_size),
            "w2": draw.uniform(-second, second, (self.num_classes, self.hidden_size)),
            "b2": draw.uniform(-second, second, self.num_classes),
        }


def logits_of(p: Parameters, x: np.ndarray) -> np.ndarray:
    return np.maximum(x @ p["w1"].T + p["b1"], 0.0) @ p["w2"].T + p["b2"]


def probabilities_of(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def losses_of(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1)
    return np.log(np.exp(logits - top[:, None]).sum(axis=1)) + top - logits[np.arange(len(y)), y]


def gradient_sums(p: Parameters, x: np.ndarray, y: np.ndarray) -> tuple[float, int, Parameters]:
    """Summed loss, correct rows and summed gradients of a batch."""
    hidden = np.maximum(x @ p["w1"].T + p["b1"], 0.0)
    logits = hidden @ p["w2"].T + p["b2"]
    out = probabilities_of(logits)
    out[np.arange(len(y)), y] -= 1.0
    back = (out @ p["w2"]) * (hidden > 0)
    grads = {"w1": back.T @ x, "b1": back.sum(axis=0), "w2": out.T @ hidden, "b2": out.sum(axis=0)}
    return float(losses_of(logits, y).sum()), int((logits.argmax(axis=1) == y).sum()), grads


def pack(p: Parameters) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in ("w1", "b1", "w2", "b2")])


def unpack(flat: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for n in ("w1", "b1", "w2", "b2"):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


class Adam:
    """The only optimizer there is."""

    def __init__(self, size: int, rate: float = LEARNING_RATE):
        self.rate, self.steps = rate, 0
        self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        b1, b2 = BETAS
        self.steps += 1
        self.m = b1 * self.m + (1 - b1) * gradient
        self.v = b2 * self.v + (1 - b2) * gradient**2
        m = self.m / (1 - b1**self.steps)
        v = self.v / (1 - b2**self.steps)
        return flat - self.rate * m / (np.sqrt(v) + EPSILON)


def optimizer(name: str, size: int, rate: float = LEARNING_RATE) -> Adam:
    if name.lower() != "adam":
        raise ValueError(f"unsupported optimizer: {name}; only Adam is")
    return Adam(size, rate)


# ---- over tables


def feature_matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column as a matrix, without a copy per row."""
    lengths = column.value_lengths()
    if column.null_count or not np.all(lengths.to_numpy(zero_copy_only=False) == width):
        raise ValueError(f"every feature row must hold {width} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def usable_rows(column: pa.Array, width: int) -> np.ndarray:
    """Which rows hold `width` finite numbers."""
    good = column.value_lengths().fill_null(-1).to_numpy() == width
    at = np.flatnonzero(good)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    good[at] = np.isfinite(values.astype(np.float64)).all(axis=1)
    return good


def label_vector(column: pa.Array, classes: int) -> np.ndarray:
    labels = column.to_numpy(zero_copy_only=False)
    if column.null_count or (len(labels) and not (0 <= labels.min() and labels.max() < classes)):
        raise ValueError(f"every label must be a class from 0 to {classes - 1}")
    return labels.astype(np.int64)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def score(
    df: DataFrame, parameters: Parameters, features: str = "features", keep: Sequence[str] = (), label: str | None = None
) -> DataFrame:
    """Logits, prediction, confidence and probabilities of every row; the loss too when a label is given.

    A row whose features are missing, of another length or not all numbers is flagged `bad` and has nulls instead; a
    label that is no class has a null loss. Works on tables and on streams.
    """
    width, classes = parameters["w1"].shape[1], parameters["w2"].shape[0]
    shared = df.sparkSession.sparkContext.broadcast(parameters)
    kept = [*keep, *([label] if label and label not in keep else [])]
    double_list = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [df.schema[k] for k in kept]
        + [
            T.StructField("logits", double_list),
            T.StructField("prediction", T.IntegerType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("probabilities", double_list),
            T.StructField("bad", T.BooleanType()),
        ]
        + ([T.StructField("loss", T.DoubleType())] if label else [])
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = usable_rows(batch.column(features), width)
            at = np.flatnonzero(good)
            # Where a row's result is among those of the good rows; nowhere for a bad one.
            place = pa.array(np.cumsum(good) - 1, mask=~good)
            logits = logits_of(shared.value, feature_matrix(batch.column(features).take(pa.array(at)), width))
            odds = probabilities_of(logits)
            best = odds.argmax(axis=1)
            found = [
                _lists(logits),
                pa.array(best.astype(np.int32)),
                pa.array(odds[np.arange(len(best)), best]),
                _lists(np.round(odds, 4)),
            ]
            arrays = [batch.column(k) for k in kept] + [f.take(place) for f in found] + [pa.array(~good)]
            if label:
                told = batch.column(label).take(pa.array(at)).fill_null(-1).to_numpy().astype(np.int64)
                known = (told >= 0) & (told < classes)
                losses = losses_of(logits, np.where(known, told, 0))
                arrays.append(pa.array(losses, mask=~known).take(place))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*kept, features).mapInArrow(apply, schema)


#: Losses are added up in these units; those too large for them, or no numbers, make a mean of nan.
LOSS_UNITS = float(1 << 36)
LARGEST_LOSS = float(1 << 20)


def evaluated(
    df: DataFrame, parameters: Parameters, features: str = "features", label: str = "label", by: str | None = None
) -> DataFrame:
    """Rows, mean loss and accuracy of a table, by the values of a column if one is given.

    Losses and hits are added up inside each Arrow batch, so that only sums leave a task, not scores. Losses are added as whole
    numbers of 2^-36, so that the mean does not depend on the order in which tasks end.
    """
    width, classes = parameters["w1"].shape[1], parameters["w2"].shape[0]
    shared = df.sparkSession.sparkContext.broadcast(parameters)
    key = [T.StructField(by, df.schema[by].dataType)] if by else []
    names = ("n", "high", "low", "odd", "correct")
    sums = [T.StructField(name, T.LongType()) for name in names]
    schema = T.StructType(key + sums)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = label_vector(batch.column(label), classes)
            logits = logits_of(shared.value, feature_matrix(batch.column(features), width))
            groups = batch.column(by).dictionary_encode(null_encoding="encode") if by else None
            codes = groups.indices.to_numpy() if by else np.zeros(len(y), np.int64)
            n = np.bincount(codes)
            hits = np.bincount(codes, logits.argmax(axis=1) == y).astype(np.int64)
            loss = losses_of(logits, y)
            odd = ~(loss < LARGEST_LOSS)
            units = np.rint(np.where(odd, 0.0, loss) * LOSS_UNITS).astype(np.int64)
            parts = [np.zeros(len(n), np.int64) for _ in range(3)]
            for total, part in zip(parts, (units >> 24, units & 0xFFFFFF, odd.astype(np.int64)), strict=True):
                np.add.at(total, codes, part)
            added = [pa.array(n.astype(np.int64)), *map(pa.array, parts), pa.array(hits)]
            yield pa.RecordBatch.from_arrays(([groups.dictionary] if by else []) + added, names=schema.names)

    columns = list(dict.fromkeys([*([by] if by else []), features, label]))
    partial = df.select(*columns).mapInArrow(add_up, schema)
    grouped = partial.groupBy(by) if by else partial.groupBy()
    loss = (F.sum("high") * float(1 << 24) + F.sum("low")) / LOSS_UNITS
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.when(F.sum("odd") > 0, F.lit(float("nan"))).otherwise(F.try_divide(loss, F.sum("n"))).alias("loss"),
        F.try_divide(F.sum("correct"), F.sum("n")).alias("accuracy"),
    )


PARTIAL_SCHEMA = "n bigint, loss double, correct bigint, gradient binary"


def _partial(n: int, loss: float, correct: int, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([n]), pa.array([loss]), pa.array([correct]), pa.array([gradient.tobytes()], pa.binary())],
        names=["n", "loss", "correct", "gradient"],
    )


def gradient_job(
    df: DataFrame, parameters: Parameters, features: str, label: str, tasks: int | None = None
) -> tuple[int, float, int, np.ndarray]:
    """Rows, summed loss, correct rows and summed gradient over a table.

    Each task hands on one row. With many tasks those rows are first added up in about as
    many groups as the square root of their number, so neither a task nor the driver reads
    more than that many gradients.
    """
    width, classes = parameters["w1"].shape[1], parameters["w2"].shape[0]
    size = pack(parameters).size
    shared = df.sparkSession.sparkContext.broadcast(parameters)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, correct, total = 0, 0.0, 0, np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                y = label_vector(batch.column(label), classes)
                l, c, g = gradient_sums(shared.value, feature_matrix(batch.column(features), width), y)
                n, loss, correct, total = n + len(y), loss + l, correct + c, total + pack(g)
        if n:
            yield _partial(n, loss, correct, total)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, correct, total = 0, 0.0, 0, np.zeros(size)
        for batch in batches:
            for row in batch.to_pylist():
                n, loss, correct = n + row["n"], loss + row["loss"], correct + row["correct"]
                total += np.frombuffer(row["gradient"])
        if n:
            yield _partial(n, loss, correct, total)

    source = df.select(features, label)
    partials = source.mapInArrow(per_task, PARTIAL_SCHEMA)
    tasks = tasks or source.rdd.getNumPartitions()
    if tasks > 64:
        partials = partials.repartition(math.isqrt(tasks)).mapInArrow(add_up, PARTIAL_SCHEMA)
    rows = partials.collect()
    gradient = sum((np.frombuffer(r["gradient"]) for r in rows), np.zeros(size))
    shared.unpersist()
    return sum(r["n"] for r in rows), sum(r["loss"] for r in rows), sum(r["correct"] for r in rows), gradient


ROUND_SCHEMA = "bucket int, n bigint, loss double, correct bigint, parameters binary, first binary, second binary, steps bigint"


def local_round(
    df: DataFrame, parameters: Parameters, adam: Adam, features: str, label: str, batch_size: int
) -> tuple[int, float, int, np.ndarray]:
    """One pass in small batches, bucket by bucket; the buckets' parameters are then averaged by their rows.

    Rows of a bucket must lie together and in order, as `batch_size` of them make a batch; they stream through. Every
    bucket starts from the same parameters and moments, and hands on one row. `adam` takes up the averaged moments.
    """
    width, classes = parameters["w1"].shape[1], parameters["w2"].shape[0]
    shared = df.sparkSession.sparkContext.broadcast((parameters, adam.m, adam.v, adam.steps, adam.rate))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held_x, held_y, held = None, [], [], 0

        def begin():
            start, m, v, steps, rate = shared.value
            own = Adam(m.size, rate)
            own.m, own.v, own.steps = m, v, steps
            return start, own, [0, 0.0, 0]

        def take(x, y):
            nonlocal now
            loss, correct, grads = gradient_sums(now, x, y)
            now = unpack(own.step(pack(now), pack(grads) / len(y)), now)
            sums[0], sums[1], sums[2] = sums[0] + len(y), sums[1] + loss, sums[2] + correct

        def finish():
            if held:
                take(np.concatenate(held_x), np.concatenate(held_y))
            values = [bucket, *sums, pack(now).tobytes(), own.m.tobytes(), own.v.tobytes(), own.steps]
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            names = [c.split()[0] for c in ROUND_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        now, own, sums = begin()
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("bucket").to_numpy()
            x, y = feature_matrix(batch.column(features), width), label_vector(batch.column(label), classes)
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if bucket is not None and numbers[first] != bucket:
                    yield finish()
                    held_x, held_y, held = [], [], 0
                    now, own, sums = begin()
                bucket = int(numbers[first])
                at = first
                while at < end:
                    some = min(batch_size - held, end - at)
                    held_x.append(x[at : at + some])
                    held_y.append(y[at : at + some])
                    held, at = held + some, at + some
                    if held == batch_size:
                        take(np.concatenate(held_x), np.concatenate(held_y))
                        held_x, held_y, held = [], [], 0
        if bucket is not None:
            yield finish()

    # One row per bucket; their number is a setting. Sorted, so that sums do not depend on who came first.
    rows = sorted(df.select("bucket", features, label).mapInArrow(follow, ROUND_SCHEMA).collect(), key=lambda r: r["bucket"])
    shared.unpersist()
    n = sum(r["n"] for r in rows)

    def mean(name: str) -> np.ndarray:
        return sum(np.frombuffer(r[name]) * (r["n"] / n) for r in rows)

    if n:
        adam.m, adam.v, adam.steps = mean("first"), mean("second"), max(r["steps"] for r in rows)
    flat = mean("parameters") if n else pack(parameters)
    return n, sum(r["loss"] for r in rows), sum(r["correct"] for r in rows), flat
