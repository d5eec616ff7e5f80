"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Known are some toxic texts and many texts of which nothing is said. With the share of toxic texts among all (the class
prior), the risk of calling an unlabelled text toxic can be corrected for the toxic ones among them; the corrected part
is kept from going below zero, as it would when the classifier learns the unlabelled sample by heart. The classifier is linear
over the words and word beginnings that a whole text holds.

Defined cases: null and empty texts hold no words and get the score of the bias; rows without id or label are not learned
from; of contradicting labels for an id the larger counts; without toxic labels every score is 0; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelyard.llm.bytewords import WordHasher, letters_and_digits, mixed
from modelyard.llm.learning import chosen_labels
from modelyard.session import pinned

PREFIXES = (5, 7)


@dataclass(frozen=True)
class ToxicitySettings:
    """positive, unlabelled: documents to learn from, at most. least: toxic documents that must hold a feature.
    lift: how many times as frequent among them it must be as among the unlabelled."""

    positive: int = 4_000
    unlabelled: int = 12_000
    least: int = 5
    least_share: float = 0.01
    lift: float = 2.0
    features: int = 50_000
    steps: int = 400
    rate: float = 0.05
    l1: float = 5e-5
    seed: int = 3


def held(hasher: WordHasher, texts: pa.Array):
    """Per row, the distinct hashes of its words and word beginnings."""
    for _, words, bounds in hasher.runs(texts):
        words = np.atleast_2d(words) if words.size else np.zeros((1 + len(PREFIXES), 0), np.uint64)
        for i in range(len(bounds) - 1):
            yield np.unique(words[:, bounds[i] : bounds[i + 1]])


@dataclass
class ToxicityModel:
    """features (sorted hashes), weights and bias; score = sigmoid(bias + weights of the features held)."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(self.features):
            return np.zeros(len(texts))
        hasher, found = WordHasher(letters_and_digits(), prefixes=PREFIXES), []
        places = np.zeros(1 << 20, bool)
        places[(self.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for _, words, bounds in hasher.runs(texts):
            total = np.full(len(bounds) - 1, self.bias)
            if words.size:
                line, at = np.nonzero(places[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
                own = words[line, at]
                index = np.minimum(np.searchsorted(self.features, own), len(self.features) - 1)
                same = self.features[index] == own
                row = np.searchsorted(bounds, at[same], "right") - 1
                pairs = np.unique(row * len(self.features) + index[same])
                np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
            found.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return np.concatenate(found) if found else np.zeros(0)


def minima(held: np.ndarray) -> np.ndarray:
    """Eight minima of hashes of what a document holds."""
    return np.array([mixed(held ^ salt).min() for salt in mixed(np.arange(1, 9, dtype=np.uint64))], np.uint64)


def one_of_each(least: np.ndarray) -> list[int]:
    """Which rows of minima to keep: the first of each group of near copies, so that a copied text does not pass for evidence."""
    kept = []
    for i in range(len(least)):
        if not kept or (least[kept] == least[i]).sum(1).max() < 4:
            kept.append(i)
    return kept


def without_copies(docs: list[np.ndarray]) -> list[np.ndarray]:
    """One of each group of near copies."""
    docs = [d for d in docs if len(d)]
    return [docs[i] for i in one_of_each(np.array([minima(d) for d in docs], np.uint64).reshape(-1, 8))]


def candidates(positive: list[np.ndarray], settings: ToxicitySettings) -> tuple[np.ndarray, np.ndarray]:
    """Features that enough toxic documents hold, and how many do."""
    names, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *positive]), return_counts=True)
    enough = n >= max(settings.least, settings.least_share * len(positive))
    return names[enough], n[enough]


def fitted(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: ToxicitySettings) -> ToxicityModel:
    """The non-negative risk: prior * loss(toxic as toxic) + max(0, loss(unlabelled as clean) - prior * loss(toxic as clean))."""
    return fitted_to(without_copies(positive), unlabelled, prior, settings)


def fitted_to(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: ToxicitySettings) -> ToxicityModel:
    """The same from toxic documents without near copies; features that too few of them hold may have been left out."""
    if not positive or not unlabelled:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    names, n = candidates(positive, settings)
    every = np.concatenate(unlabelled)
    every = every[names[np.minimum(np.searchsorted(names, every), len(names) - 1)] == every] if len(names) else every[:0]
    common = np.bincount(np.searchsorted(names, every), minlength=len(names))
    lift = (n / len(positive)) / ((common + 1) / len(unlabelled))
    best = np.lexsort((names, -lift))[: settings.features]
    features = np.sort(names[best[lift[best] >= settings.lift]])
    if not len(features):
        return ToxicityModel(features, np.zeros(0), -30.0)

    def rows(docs):
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        flat = np.concatenate(docs)
        at = np.minimum(np.searchsorted(features, flat), len(features) - 1)
        same = features[at] == flat
        return row[same], at[same], len(docs)

    p, u = rows(positive), rows(unlabelled)
    weights, bias, moment, speed = np.zeros(len(features)), 0.0, np.zeros(len(features) + 1), np.zeros(len(features) + 1)

    def raw(x):
        return np.bincount(x[0], weights[x[1]], x[2]) + bias

    def push(x, by_row):
        return np.append(np.bincount(x[1], by_row[x[0]], len(features)), by_row.sum())

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    for step in range(1, settings.steps + 1):
        # Logistic loss: log(1 + exp(-g)) for toxic, log(1 + exp(g)) for clean.
        of_p, of_u = raw(p), raw(u)
        as_clean = np.logaddexp(0, of_u).mean() - prior * np.logaddexp(0, of_p).mean()
        corrected = push(u, sigmoid(of_u) / u[2]) - prior * push(p, sigmoid(of_p) / p[2])
        if as_clean >= 0:
            grad = prior * push(p, -sigmoid(-of_p) / p[2]) + corrected
        else:
            grad = -corrected
        moment += 0.1 * (grad - moment)
        speed += 0.01 * (grad * grad - speed)
        scale = settings.rate / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
        change = scale * moment / (1 - 0.9**step)
        # Features were chosen as signs of toxicity; what they add falls to zero unless it lowers the risk enough.
        weights = np.maximum(0, weights - change[:-1] - scale[:-1] * settings.l1)
        bias -= change[-1]
    at = np.flatnonzero(weights)
    features, weights = features[at], weights[at]
    return ToxicityModel(features, weights, float(bias))


def learned(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    settings: ToxicitySettings | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> ToxicityModel:
    """`learn` is a condition on the id; confirmed toxic documents and unlabelled ones both come from such rows only.

    The class prior is the share of toxic documents among the labelled ones.
    """
    settings = settings or ToxicitySettings()
    known = labels.filter(learn & F.col(label).isNotNull())
    prior = known.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0] or 0.0
    toxic = chosen_labels(known.filter(F.col(label) > 0), F.lit(True), doc_id, label, settings.positive, settings.seed)
    texts = docs.filter(learn & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    confirmed = pinned(_holding(texts, toxic).filter("size(held) > 0"))
    least = confirmed.select("doc_id", "least").orderBy("doc_id").toArrow().combine_chunks()
    marks = least.column("least").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 8)
    ids = pa.table([least.column("doc_id").take(pa.array(one_of_each(marks), pa.int64()))], names=["doc_id"])
    if not ids.num_rows:
        return fitted_to([], [], prior, settings)
    kept = confirmed.join(F.broadcast(docs.sparkSession.createDataFrame(ids)), "doc_id")
    # A feature that too few hold is no candidate: the driver gets those that a hundredth of the kept documents hold at least.
    enough = max(settings.least, settings.least_share * ids.num_rows)
    shared = kept.select(F.explode("held").alias("feature")).groupBy("feature").count().filter(F.col("count") >= enough)
    names = np.sort(shared.select("feature").toArrow().column(0).to_numpy().view(np.uint64))
    order = F.xxhash64("doc_id", F.lit(settings.seed + 1))
    some = texts.select("doc_id").distinct().orderBy(order, "doc_id").limit(settings.unlabelled)
    positive, unlabelled = _collected(kept, names), _collected(_holding(texts, some, names), names)
    return fitted_to(positive, unlabelled, prior, settings)


def _holding(texts: DataFrame, sample: DataFrame, names: np.ndarray | None = None) -> DataFrame:
    """doc_id, held (distinct hashes, of `names` only, if given), least (its minima): one row per id of the sample.

    Of rows that share an id, the one that holds the smallest list counts.
    """
    sent = texts.sparkSession.sparkContext.broadcast(names) if names is not None else None

    def hashes(batches):
        hasher = WordHasher(letters_and_digits(), prefixes=PREFIXES)
        for batch in batches:
            own = list(held(hasher, batch.column("text")))
            if sent is not None:
                own = [np.intersect1d(d, sent.value, assume_unique=True) for d in own]
            least = [minima(d) if len(d) else d for d in own]
            lists = []
            for rows in (own, least):
                ends = pa.array(np.cumsum([0, *map(len, rows)], dtype=np.int32))
                lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "held", "least"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.join(F.broadcast(sample.select("doc_id")), "doc_id")
    found = rows.mapInArrow(hashes, f"doc_id {kind}, held array<long>, least array<long>")
    return found.groupBy("doc_id").agg(F.min(F.struct("held", "least")).alias("own")).select("doc_id", "own.held", "own.least")


def _collected(holding: DataFrame, names: np.ndarray) -> list[np.ndarray]:
    """What documents hold of `names`, in the order of their ids."""
    sent = holding.sparkSession.sparkContext.broadcast(names)

    def pick(batches):
        for batch in batches:
            lists = batch.column("held")
            own, ends = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            same = np.isin(own, sent.value)
            row = np.repeat(np.arange(len(ends)), ends)[same]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ends)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(own[same].view(np.int64)))], names=["doc_id", "held"]
            )

    kind = holding.schema["doc_id"].dataType.simpleString()
    found = holding.select("doc_id", "held").mapInArrow(pick, f"doc_id {kind}, held array<long>").orderBy("doc_id").toArrow()
    lists = found.column("held").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def scored(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and `score`."""
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema

    def score(batches):
        for batch in batches:
            found = pa.array(model.score(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(score, schema)
