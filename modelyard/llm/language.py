"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths slide over the bytes of fixed-length windows, each filter's maximum over a window goes into a
softmax over the learned languages, and the windows of a whole text are averaged by length. For scoring, embedding and
filters are folded into tables over pairs of bytes, so that a filter bank costs two lookups per byte.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything where nothing could be learned;
rows without id or language are never learned from; equal scores go to the language that sorts first; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelyard.llm.bytewords import pieces, texts_of

UNKNOWN = "und"
PAD = 4


@dataclass(frozen=True)
class LanguageSettings:
    """sample: excerpts per language to learn from, at most; total: those of all languages, divided among them so that each
    has one at least; excerpt: their characters."""

    sample: int = 1000
    excerpt: int = 300
    total: int = 200_000
    window: int = 256
    filters: tuple[tuple[int, int], ...] = ((2, 8), (3, 12), (4, 12))
    embedding: int = 8
    steps: int = 600
    batch: int = 96
    rate: float = 0.01
    seed: int = 11


@dataclass
class ByteNetwork:
    """languages, and the parameters: embedding (256, e), per width filters (width * e, n) and bias, output (n, k) and bias."""

    languages: list[str]
    settings: LanguageSettings
    params: dict[str, np.ndarray]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the pair of bytes at a place and the pair two places on add to every filter."""
        e, near, far = self.params["embedding"], [], []
        for width, n in self.settings.filters:
            weights = self.params[f"filter{width}"].reshape(width, -1, n)
            at = [e @ w for w in weights] + [np.zeros((256, n), np.float32)] * (4 - width)
            near.append((at[0][:, None] + at[1][None]).reshape(65536, n) + self.params[f"bias{width}"])
            far.append((at[2][:, None] + at[3][None]).reshape(65536, n))
        return np.concatenate(near, 1).astype(np.float32), np.concatenate(far, 1).astype(np.float32)


def _adam(params, grads, state, step, rate):
    for name, grad in grads.items():
        m, v = state.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        params[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def trained(excerpts: list[tuple[str, bytes]], settings: LanguageSettings) -> ByteNetwork | None:
    """The network learned from (language, bytes); None without any."""
    languages = sorted({name for name, _ in excerpts})
    if not languages:
        return None
    rng = np.random.default_rng(settings.seed)
    of_language = [[data for name, data in excerpts if name == own and data] for own in languages]
    of_language = [own or [b" "] for own in of_language]
    e, total = settings.embedding, sum(n for _, n in settings.filters)
    params = {"embedding": rng.normal(0, 0.5, (256, e)), "output": rng.normal(0, 0.1, (total, len(languages)))}
    params["bias"] = np.zeros(len(languages))
    for width, n in settings.filters:
        params[f"filter{width}"] = rng.normal(0, (width * e) ** -0.5, (width * e, n))
        params[f"bias{width}"] = np.zeros(n)
    params = {name: value.astype(np.float32) for name, value in params.items()}
    state, w = {}, settings.window
    for step in range(1, settings.steps + 1):
        # Crops of all lengths, short ones as often as long ones, so that short texts are known too.
        label = rng.integers(0, len(languages), settings.batch)
        lengths = np.exp(rng.uniform(np.log(4), np.log(w), settings.batch)).astype(int)
        data = np.zeros((settings.batch, w + PAD), np.uint8)
        for i, (own, length) in enumerate(zip(label, lengths, strict=True)):
            text = of_language[own][rng.integers(len(of_language[own]))]
            at = rng.integers(0, max(1, len(text) - length + 1))
            crop = np.frombuffer(text, np.uint8)[at : at + length]
            data[i, : len(crop)] = crop
            lengths[i] = len(crop)
        embedded = params["embedding"][data]
        pooled, best = [], []
        outside = np.arange(w)[None, :] >= lengths[:, None]
        for width, _ in settings.filters:
            patches = np.concatenate([embedded[:, i : i + w] for i in range(width)], 2)
            values = patches @ params[f"filter{width}"] + params[f"bias{width}"]
            values[outside] = 0
            best.append(values.argmax(1))
            pooled.append(np.maximum(values.max(1), 0))
        hidden = np.concatenate(pooled, 1)
        logits = hidden @ params["output"] + params["bias"]
        share = np.exp(logits - logits.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        share[np.arange(len(label)), label] -= 1
        share /= len(label)
        grads = {"output": hidden.T @ share, "bias": share.sum(0), "embedding": np.zeros_like(params["embedding"])}
        back, column = (share @ params["output"].T) * (hidden > 0), 0
        rows = np.arange(settings.batch)[:, None]
        for (width, n), at in zip(settings.filters, best, strict=True):
            own = back[:, column : column + n]
            column += n
            seen = np.stack([data[rows, at + i] for i in range(width)], 2)  # the bytes under each filter's maximum
            patches = params["embedding"][seen].reshape(settings.batch, n, width * e)
            grads[f"filter{width}"] = np.einsum("bnp,bn->pn", patches, own)
            grads[f"bias{width}"] = own.sum(0)
            down = own[:, :, None] * params[f"filter{width}"].T[None]
            np.add.at(grads["embedding"], seen.reshape(-1), down.reshape(-1, e))
        _adam(params, grads, state, step, settings.rate * (1 - 0.9 * step / settings.steps))
    return ByteNetwork(languages, settings, params)


def excerpts(docs: DataFrame, settings: LanguageSettings, doc_id: str, text: str, lang: str, learn: Column) -> list:
    """Excerpts of every language, at most `sample` of each, from places and rows chosen by the hash of the id."""
    chance = F.xxhash64(F.col(doc_id), F.lit(settings.seed))
    first = F.pmod(F.shiftright(chance, 7), F.greatest(F.lit(1), F.length(text) - settings.excerpt)).cast("int")
    rows = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.length(text) > 0) & learn).select(
        F.col(lang).alias("lang"), chance.alias("chance"), F.substring(F.col(text), first + 1, F.lit(settings.excerpt)).alias("text")
    )
    share = max(1, settings.total // max(1, rows.select("lang").distinct().count()))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "text"))
    chosen = rows.withColumn("nth", nth).filter(F.col("nth") <= min(settings.sample, share))
    return sorted((row["lang"], row["text"].encode()) for row in chosen.select("lang", "text").collect())


def _has_letter(data: np.ndarray) -> bool:
    folded = data | 0x20
    if ((folded >= 0x61) & (folded <= 0x7A) & (data < 0x80)).any():
        return True
    return bool((data >= 0x80).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


class Scorer:
    """Scores whole texts, a few hundred windows at a time; made once per task."""

    def __init__(self, network: ByteNetwork):
        self.network, self.window = network, network.settings.window
        self.near, self.far = network.tables()

    def windows(self, data: np.ndarray, starts: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The languages' shares per window; `data` has zeros behind every text, where `gap` is set."""
        shares, step = [], 128
        for i in range(0, len(starts), step):
            first = starts[i]
            end = starts[i + step] if i + step < len(starts) else len(data) - PAD
            own = data[first : end + 3].astype(np.int32)
            pairs = (own[:-1] << 8) | own[1:]
            values = self.near[pairs[: end - first]] + self.far[pairs[2 : end - first + 2]]
            values[gap[first:end]] = 0
            hidden = np.maximum(np.maximum.reduceat(values, starts[i : i + step] - first, axis=0), 0)
            logits = hidden @ self.network.params["output"] + self.network.params["bias"]
            share = np.exp(logits - logits.max(1, keepdims=True))
            shares.append(share / share.sum(1, keepdims=True))
        return np.concatenate(shares)

    def texts(self, column: pa.Array) -> Iterator[tuple[str, float]]:
        whole, offsets = texts_of(column)
        for first, end in pieces(offsets, 1 << 20):
            at = offsets[first : end + 1] - offsets[first]
            own = whole[offsets[first] : offsets[end]]
            lengths = np.diff(at)
            moved = at[:-1] + PAD * np.arange(end - first)
            data, gap = np.zeros(len(own) + PAD * (end - first), np.uint8), np.ones(len(own) + PAD * (end - first), bool)
            for a, b, n in zip(at.tolist(), moved.tolist(), lengths.tolist(), strict=False):
                data[b : b + n], gap[b : b + n] = own[a : a + n], False
            counts = -(-lengths // self.window)
            row = np.repeat(np.arange(end - first), counts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            best = np.zeros((end - first, len(self.network.languages)))
            if len(row):
                weight = np.minimum(self.window, lengths[row] - nth * self.window)
                shares = self.windows(data, moved[row] + nth * self.window, gap) * weight[:, None]
                np.add.at(best, row, shares)
            for i, n in enumerate(lengths.tolist()):
                if n and _has_letter(own[at[i] : at[i + 1]]):
                    top = int(best[i].argmax())
                    yield self.network.languages[top], min(1.0, float(best[i, top]) / n)
                else:
                    yield UNKNOWN, 0.0


def learned(docs: DataFrame, learn: Column, settings: LanguageSettings | None = None, **columns: str) -> ByteNetwork | None:
    settings = settings or LanguageSettings()
    named = {"doc_id": "doc_id", "text": "text", "lang": "lang"} | columns
    return trained(excerpts(docs, settings, named["doc_id"], named["text"], named["lang"], learn), settings)


def identified(
    docs: DataFrame, network: ByteNetwork | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The rows with the predicted language and its share added under `names`; columns of these names are replaced."""
    kept = [name for name in docs.columns if name not in names]
    schema = docs.select(*kept, F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema

    def score(batches):
        scorer = Scorer(network) if network else None
        for batch in batches:
            texts = batch.column(kept.index(text))
            found = list(scorer.texts(texts)) if scorer else [(UNKNOWN, 0.0)] * len(batch)
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return docs.select(*kept).mapInArrow(score, schema)
