"""A quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on the residual of one feature at a time, feature after feature in a cycle, add up to one lookup table per
feature; then tables for the pairs of features that explain most of what is left. A score is a sum of table entries,
so scoring a batch is a handful of vectorised additions. Features are counted over the whole text.

Defined cases: null and empty texts have features of 0 and are scored like others; rows without id or label are not learned
from; of contradicting labels for an id the larger counts; with no labels, or of one kind only, every score is that
share of labels (0.5 without any); an empty table gives no rows; other columns are kept or not looked at, as each function says.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelyard.llm.bytewords import WordHasher, between_spaces, texts_of
from modelyard.llm.learning import chosen_labels

FEATURES = (
    "bytes", "letters", "capitals", "digits", "spaces", "lines", "stops", "symbols", "exclamations", "bars", "marks",
    "words", "word_bytes", "distinct_words", "repeated_next", "top_word", "distinct_lines", "distinct_triples",
)


@dataclass(frozen=True)
class AdditiveSettings:
    """sample: labelled documents to learn from, at most. rounds: cycles over all features. pairs: interactions."""

    sample: int = 20_000
    bins: int = 32
    rounds: int = 120
    rate: float = 0.15
    pairs: int = 4
    pair_bins: int = 8
    pair_rounds: int = 40
    leaf: int = 8
    seed: int = 5


def _classes() -> dict[str, np.ndarray]:
    def of(characters: bytes) -> np.ndarray:
        table = np.zeros(256)
        table[list(characters)] = 1
        return table

    letters = of(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
    return {
        "letters": letters,
        "capitals": of(bytes(range(65, 91))),
        "digits": of(b"0123456789"),
        "spaces": of(b" \t\n\x0b\x0c\r"),
        "lines": of(b"\n"),
        "stops": of(b".,;:"),
        "symbols": 1 - letters - of(b"0123456789 \t\n\x0b\x0c\r.,;:'\"()-?"),
        "exclamations": of(b"!"),
        "bars": of(b"|"),
        "marks": of(b"#$%&*@^~+=_"),
    }


class Measure:
    """Features of whole texts; made once per task."""

    def __init__(self):
        self.words = WordHasher(between_spaces())
        lines = np.ones(256, bool)
        lines[0x0A] = False
        self.lines = WordHasher(lines)
        classes = _classes()
        self.shares = np.stack([classes[name] for name in FEATURES[1:11]], 1)

    def column(self, texts: pa.Array) -> np.ndarray:
        data, offsets = texts_of(texts)
        found = np.zeros((len(texts), len(FEATURES)))
        for i, (words, lines) in enumerate(zip(self.words.rows(texts), self.lines.rows(texts), strict=True)):
            own = data[offsets[i] : offsets[i + 1]]
            n = len(own)
            if not n:
                continue
            found[i, 0] = np.log1p(n)
            found[i, 1:11] = np.bincount(own, minlength=256) @ self.shares / n
            found[i, 11] = np.log1p(len(words))
            if not len(words):
                continue
            found[i, 12] = (1 - found[i, 4]) * n / len(words)
            _, counts = np.unique(words, return_counts=True)
            found[i, 13] = len(counts) / len(words) ** 0.8
            found[i, 14] = np.count_nonzero(words[1:] == words[:-1]) / len(words)
            found[i, 15] = counts.max() / len(words)
            found[i, 16] = len(np.unique(lines)) / max(1, len(lines))
            triples = words[2:] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[:-2]
            found[i, 17] = len(np.unique(triples)) / max(1, len(triples))
        return found


@dataclass
class AdditiveModel:
    """score = sigmoid(base + sum of tables[f][bin] + sum of pair tables[bin, bin])."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: list[np.ndarray]

    def score(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], features[:, f], "right")]
        for f, g, table in self.pairs:
            rows = np.searchsorted(self.coarse[f], features[:, f], "right")
            total += table[rows, np.searchsorted(self.coarse[g], features[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal numbers of rows, halfway between values that occur."""
    at = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    distinct = np.unique(values)
    above = np.searchsorted(distinct, at, "right")
    return np.unique([(distinct[i - 1] + distinct[i]) / 2 for i in above if i < len(distinct)])


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaf: int, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins: each bin's leaf value, from sums of gradients, curvatures and rows."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return value
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    gains[(left_n < leaf) | (n.sum() - left_n < leaf)] = -np.inf
    cut = int(gains.argmax()) + 1
    if not gains[cut - 1] > _gain(g.sum(), h.sum()):
        return value
    halves = [_tree(g[s], h[s], n[s], leaf, depth - 1) for s in (slice(cut), slice(cut, None))]
    return np.concatenate(halves)


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaf: int) -> tuple[np.ndarray, float]:
    """The best cut of each feature at once: four leaves over a grid of bins, and how much they explain."""

    def corner(x):
        low = np.cumsum(np.cumsum(x, 0), 1)[:-1, :-1]
        rows, columns = np.cumsum(x.sum(1))[:-1, None], np.cumsum(x.sum(0))[None, :-1]
        return [low, rows - low, columns - low, x.sum() - rows - columns + low]

    quarters = [corner(x) for x in (g, h, n)]
    if quarters[0][0].size == 0:
        return np.zeros_like(g), 0.0
    gains = sum(_gain(a, b) for a, b in zip(quarters[0], quarters[1], strict=True))
    gains = np.where(np.minimum.reduce(quarters[2]) >= leaf, gains, -np.inf)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    if not np.isfinite(gains[i, j]):
        return np.zeros_like(g), 0.0
    values = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(quarters[0], quarters[1], strict=True)]
    table = np.empty_like(g)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :] = values[0], values[1]
    table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = values[2], values[3]
    return table, float(gains[i, j])


def fitted(features: np.ndarray, label: np.ndarray, settings: AdditiveSettings) -> AdditiveModel:
    """Cyclic boosting of the log-loss: every tree sees the residual that all tables before it left."""
    share = label.mean() if len(label) else 0.5
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    edges = [_edges(features[:, f], settings.bins) for f in range(features.shape[1])] if len(label) else []
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(label) or share in (0.0, 1.0):
        return AdditiveModel(base, edges, tables, [], [])
    bins = [np.searchsorted(e, features[:, f], "right") for f, e in enumerate(edges)]
    total = np.full(len(label), base)

    def sums(at, size):
        chance = 1 / (1 + np.exp(-total))
        residual, curve = label - chance, chance * (1 - chance)
        return [np.bincount(at, w, size) for w in (residual, curve, np.ones(len(at)))]

    for _ in range(settings.rounds):
        for f, at in enumerate(bins):
            step = settings.rate * _tree(*sums(at, len(tables[f])), settings.leaf)
            tables[f] += step
            total += step[at]
    coarse = [_edges(features[:, f], settings.pair_bins) for f in range(features.shape[1])]
    rough = [np.searchsorted(e, features[:, f], "right") for f, e in enumerate(coarse)]

    def grid(f, g):
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        return [x.reshape(shape) for x in sums(rough[f] * shape[1] + rough[g], shape[0] * shape[1])]

    every = [(f, g) for f in range(len(tables)) for g in range(f) if len(coarse[f]) and len(coarse[g])]
    every.sort(key=lambda p: (-_pair_tree(*grid(*p), settings.leaf)[1], p))
    pairs = [(f, g, np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))) for f, g in every[: settings.pairs]]
    for _ in range(settings.pair_rounds):
        for f, g, table in pairs:
            step = settings.rate * _pair_tree(*grid(f, g), settings.leaf)[0]
            table += step
            total += step[rough[f], rough[g]]
    return AdditiveModel(base, edges, tables, pairs, coarse)


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and `features`, an array of doubles in the order of FEATURES."""
    schema = docs.select(*keep, F.array(F.lit(0.0)).alias("features")).schema

    def measure(batches):
        own = Measure()
        for batch in batches:
            found = own.column(batch.column(len(keep)))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            features = pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], features], names=[*keep, "features"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(measure, schema)


def learned(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    settings: AdditiveSettings | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> AdditiveModel:
    """The model of a bounded number of labelled documents; `learn` is a condition on the columns of `labels`.

    Of rows that share an id, the one with the smallest features counts, chosen before anything is sent to the driver.
    """
    settings = settings or AdditiveSettings()
    sample = F.broadcast(chosen_labels(labels, learn, doc_id, label, settings.sample, settings.seed))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(sample, "doc_id")
    found = measured(texts, ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("features").alias("features")).toArrow()
    order = np.lexsort((found.column("label").to_numpy(), found.column("doc_id").to_numpy()))
    features = found.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))[order]
    return fitted(features, (found.column("label").to_numpy()[order] > 0).astype(float), settings)


def scored(docs: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with the score added under `name`; a column of this name is replaced."""
    kept = [column for column in docs.columns if column != name]
    schema = docs.select(*kept, F.lit(0.0).alias(name)).schema

    def score(batches):
        own = Measure()
        for batch in batches:
            texts = batch.column(kept.index(text))
            found = model.score(own.column(texts)) if model.tables else np.full(len(batch), model.score(np.zeros((1, 0)))[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names)

    return docs.select(*kept).mapInArrow(score, schema)
