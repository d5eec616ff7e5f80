"""Token counts of whole texts by a two-tier lookup, without a shuffle of texts or of all pre-tokens.

A pre-token is a run of bytes between white space of ASCII. For a tokenizer that drops white space and splits at it, the
tokens of a text are those of its pre-tokens, special strings inside them included, so that lengths may be looked up one by one.
A tokenizer for which that does not hold is refused: pre-tokens are joined by every kind of white space, and must have as many tokens
together as apart. Tier one is a compact table of the most frequent pre-tokens' hashes and lengths, sorted and sent to every worker;
its size is bounded by `frequent`. Tier two is a cache in the worker, filled by encoding what neither tier knows.
Pre-tokens are looked up by 64-bit hashes of their bytes; two different ones are taken to differ in their hashes.

Defined cases: null and empty texts have 0 bytes and 0 tokens; ids and rows may repeat; other columns are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelyard.llm.bytewords import SPACES, WordHasher, between_spaces, mixed, pieces, texts_of

CACHED = 200_000
PER_TASK = 5_000
PIECE = 1 << 20

#: Pre-tokens that tokenizers treat in different ways, for the test of a tokenizer.
PROBES = ("a", "B", "word", "it's", "'s", "123", "4.5", "!!", "é", "日本", "x-y_z", "<b>", "ΑΣ", "…", "«q»", "́a")


class PreTokens(WordHasher):
    """Hashes of pre-tokens as they are, with the places of their bytes."""

    def __init__(self):
        super().__init__(between_spaces(), PIECE)
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # no folding of A-Z

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.concatenate([[False], self.word_bytes[data], [False]])
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[offsets < len(data)]] = True  # a row begins: what lies before is another pre-token
        opens = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
        closes = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
        return opens, closes

    def found(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of rows: the first row, the bytes, the hashes, where each row's begin (one more at the end), and the pre-tokens' places.

        A row that is longer than a piece comes in several runs, cut at white space.
        """
        data, offsets = texts_of(column)
        for first, end in pieces(offsets, PIECE):
            own, at = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
            for part, bounds in [(own, at)] if len(own) <= PIECE else self._cut(own):
                hashes, rows = self._piece(part, bounds)
                yield (first, part, hashes, rows, *self._spans(part, bounds))

    def _cut(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and self.word_bytes[data[end]]:
                gaps = np.flatnonzero(~self.word_bytes[data[end : end + PIECE]])
                end = end + int(gaps[0]) if len(gaps) else min(end + PIECE, len(data))
            yield data[at:end], np.array([0, end - at])
            at = end


def _words(data: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(opens.tolist(), closes.tolist(), strict=True)]


def frequent_pre_tokens(docs: DataFrame, text: str, most: int) -> list[bytes]:
    """About the `most` most frequent pre-tokens of all texts; tasks hand on sums, for their 5,000 first ones only.

    A task that has met more than four times CACHED different ones goes on with the CACHED most frequent. So a pre-token may be missed
    that is spread thinly over all tasks; it is then encoded where it occurs, which changes no count.
    """

    def count(batches):
        hasher, hashes, counts, words = PreTokens(), np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for batch in batches:
            for _, data, own, _, opens, closes in hasher.found(batch.column(0)):
                new, first, n = np.unique(own, return_index=True, return_counts=True)
                fresh = np.flatnonzero(~np.isin(new, hashes, assume_unique=True))
                words.update(zip(new[fresh].tolist(), _words(data, opens[first[fresh]], closes[first[fresh]]), strict=True))
                both, inverse = np.unique(np.concatenate([hashes, new]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, n]), len(both)).astype(np.int64)
                hashes = both
                if len(hashes) > 4 * CACHED:
                    kept = np.sort(np.argsort(-counts, kind="stable")[:CACHED])
                    hashes, counts = hashes[kept], counts[kept]
                    words = {h: words[h] for h in hashes.tolist()}
        top = np.argsort(-counts, kind="stable")[:PER_TASK]
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([words[h] for h in hashes[top].tolist()], pa.binary()), "n": pa.array(counts[top], pa.int64())}
        )

    counted = docs.select(text).mapInArrow(count, "word binary, n long")
    best = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [bytes(row["word"]) for row in best.collect()]


def tokenizer_from(described: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(described)


def lengths_of(tokenizer, words: list[bytes]) -> list[int]:
    """Without begin, end or added special tokens; special strings are handled as the library does by default."""
    texts = [w.decode("utf-8", "replace") for w in words]
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def refuse_unsafe(tokenizer, words: list[bytes]) -> None:
    """An error if pre-tokens joined by white space have other counts than apart."""
    probes = [p.encode() for p in PROBES] + [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values() if t.content.strip()]
    for some in (probes, words[:2_000]):
        apart = sum(lengths_of(tokenizer, some))
        for gap in [bytes([space]) for space in SPACES] + [b"  ", b"\n\n", b" \t\r\n"]:
            if lengths_of(tokenizer, [gap + gap.join(some) + gap])[0] != apart:
                raise ValueError(f"this tokenizer does not drop white space and split at it: {gap!r} between pre-tokens changes their counts")


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int, doc_id: str = "doc_id", text: str = "text", frequent: int = 50_000
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens); one row per document."""
    described = Path(tokenizer_path).read_text(encoding="utf-8")
    words, tokenizer = frequent_pre_tokens(docs, text, frequent), tokenizer_from(described)
    refuse_unsafe(tokenizer, words)
    column = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
    hashes = np.concatenate([np.zeros(0, np.uint64), *(found[2] for found in PreTokens().found(column))])
    order = np.argsort(hashes)
    lengths = np.array(lengths_of(tokenizer, words), np.int64)
    table = docs.sparkSession.sparkContext.broadcast((hashes[order], lengths[order], described))
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches):
        known, lengths, described = table.value
        hasher, tokenizer, cache = PreTokens(), tokenizer_from(described), {}
        for batch in batches:
            totals = np.zeros(len(batch), np.int64)
            for first, data, own, bounds, opens, closes in hasher.found(batch.column("text")):
                if not len(own):
                    continue
                place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                hit = known[place] == own if len(known) else np.zeros(len(own), bool)
                n = np.zeros(len(own), np.int64)
                n[hit] = lengths[place[hit]]
                missed = np.flatnonzero(~hit)
                if len(missed):
                    new, at, inverse = np.unique(own[missed], return_index=True, return_inverse=True)
                    if len(cache) > CACHED:
                        cache.clear()
                    names = new.tolist()
                    unknown = [i for i, name in enumerate(names) if name not in cache]
                    if unknown:
                        where = missed[at[unknown]]
                        found = lengths_of(tokenizer, _words(data, opens[where], closes[where]))
                        cache.update(zip([names[i] for i in unknown], found, strict=True))
                    n[missed] = np.array([cache[name] for name in names], np.int64)[inverse]
                sums = np.concatenate([[0], np.cumsum(n)])
                totals[first : first + len(bounds) - 1] += sums[bounds[1:]] - sums[bounds[:-1]]
            n_tokens = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), n_tokens], names=["doc_id", "n_bytes", "n_tokens"]
            )

    sized = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    counted = sized.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
