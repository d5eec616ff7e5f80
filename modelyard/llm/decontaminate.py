"""Finding benchmark passages in documents by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words, a window into shingles. As a whole window has to be contained,
one shingle of it is a sufficient prefix: the one that is rarest over all documents. Documents give the places of prefix
shingles, which meet the windows in a join on the shingle; position and length then say where the window would have to begin,
and the words there are compared one by one. Nothing is sent to all tasks but a bitmap of fixed size, which only spares
rows that could never join.

Defined cases: null has no words; items without words have no windows; items shorter than a window are one window; a null
item id is written as an empty string; items that share an id are one item; rows that repeat a document get its result each; an empty
table on either side gives no hits; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelyard.llm.bytewords import WordHasher, letters_and_digits, mixed, shingled
from modelyard.session import pinned, stored


@dataclass(frozen=True)
class WindowSettings:
    """window: words per window. shingle: words per prefix token. bits: places of the bitmap, a power of two."""

    window: int = 10
    shingle: int = 3
    bits: int = 1 << 22


def _longs(array: np.ndarray) -> pa.Array:
    return pa.array(array.view(np.int64))


def windows(benchmark: DataFrame, settings: WindowSettings, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """words (of a distinct window), items that hold it, tokens (its shingles in order)."""

    def cut(batches):
        hasher = WordHasher(letters_and_digits())
        for batch in batches:
            ids, spans, tokens = [], [], []
            for name, words in zip(batch.column("item").to_pylist(), hasher.rows(batch.column("text")), strict=True):
                size = min(settings.window, len(words))
                for i in range(len(words) - size + 1 if size else 0):
                    own = words[i : i + size]
                    ids.append(name)
                    spans.append(own.view(np.int64).tolist())
                    tokens.append(shingled(own, settings.shingle).view(np.int64).tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(spans, kind), pa.array(tokens, kind)], names=["item", "words", "tokens"]
            )

    chosen = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    found = chosen.mapInArrow(cut, "item string, words array<long>, tokens array<long>")
    return found.groupBy("words", "tokens").agg(F.collect_set("item").alias("items"))


def bitmap(tokens: DataFrame, bits: int) -> np.ndarray:
    """Which of `bits` places the tokens fall on; the size does not depend on their number."""
    held = tokens.select(F.expr(f"token & {bits - 1}L").cast("int").alias("place")).distinct().toArrow()
    places = np.zeros(bits, bool)
    places[held.column("place").to_numpy()] = True
    return np.packbits(places)


def _sizes(tokens: DataFrame) -> list[int]:
    """The numbers of words per token that occur: the shingle's, and less where windows are shorter."""
    return sorted(row["size"] for row in tokens.select("size").distinct().collect())


def _places(words, bounds, size: int, marks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles within a row that fall on a marked place."""
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    tokens = shingled(words, size)
    place = (tokens & np.uint64(bits - 1)).astype(np.int64)
    at = np.flatnonzero((marks[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
    row = np.searchsorted(bounds, at, "right") - 1
    at = at[at + size <= bounds[row + 1]]
    return at, tokens[at]


def token_counts(docs: DataFrame, text: str, sizes: list[int], marks: np.ndarray, bits: int) -> DataFrame:
    """token, n over all documents, for tokens that fall on a marked place; counted per batch before the shuffle."""

    def count(batches):
        hasher = WordHasher(letters_and_digits())
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, words, bounds in hasher.runs(batch.column(0)):
                found += [_places(words, bounds, size, marks, bits)[1] for size in sizes]
            tokens, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(tokens), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


PLACE = "struct<token:bigint,at:bigint,first:bigint,around:array<bigint>>"


def marked_documents(docs: DataFrame, doc_id: str, text: str, sizes, marks, settings: WindowSettings) -> DataFrame:
    """doc_id, mark (tells texts apart), n_words, places: where prefix tokens may be, and the words around them."""
    reach = settings.window

    def scan(batches):
        hasher = WordHasher(letters_and_digits())
        for batch in batches:
            n_words, texts, counts = [], [], []
            tokens, ats, firsts, arounds = [], [], [], []
            for _, words, bounds in hasher.runs(batch.column("text")):
                rows = len(bounds) - 1
                n_words.append(np.diff(bounds))
                order = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], n_words[-1]).astype(np.uint64)
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words + order * np.uint64(0x9E3779B97F4A7C15)))])
                texts.append(total[bounds[1:]] - total[bounds[:-1]])
                found = [_places(words, bounds, size, marks, settings.bits) for size in sizes]
                at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                token = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
                by_row = np.argsort(at, kind="stable")
                at, token = at[by_row], token[by_row]
                row = np.searchsorted(bounds, at, "right") - 1
                counts.append(np.bincount(row, minlength=rows))
                first = np.maximum(at - reach, bounds[row])
                until = np.minimum(at + reach, bounds[row + 1])
                tokens.append(token)
                ats.append(at - bounds[row])
                firsts.append(first - bounds[row])
                arounds += [words[a:b] for a, b in zip(first.tolist(), until.tolist(), strict=True)]
            none, no_hash = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            words_around = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, arounds)], dtype=np.int32)), _longs(np.concatenate(no_hash + arounds))
            )
            places = pa.StructArray.from_arrays(
                [
                    _longs(np.concatenate(no_hash + tokens)),
                    pa.array(np.concatenate(none + ats)),
                    pa.array(np.concatenate(none + firsts)),
                    words_around,
                ],
                names=["token", "at", "first", "around"],
            )
            ends = np.concatenate([[0], np.cumsum(np.concatenate(none + counts))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    _longs(np.concatenate(no_hash + texts)),
                    pa.array(np.concatenate(none + n_words).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), places),
                ],
                names=["doc_id", "mark", "n_words", "places"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(scan, f"doc_id {kind}, mark long, n_words long, places array<{PLACE}>")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    settings: WindowSettings | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, spans (merged word ranges that are hit: from, until), items (sorted); one row per document."""
    settings = settings or WindowSettings()
    cut = pinned(windows(benchmark, settings, item_id, item_text))
    parts = cut.select("words", "items", F.posexplode("tokens").alias("offset", "token")).withColumn(
        "size", F.least(F.size("words"), F.lit(settings.shingle))
    )
    sizes = _sizes(parts)
    seen = token_counts(docs, text, sizes, bitmap(parts, settings.bits), settings.bits)
    prefixes = pinned(
        parts.join(seen, "token", "left")
        .groupBy("words", "items")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"))
        .select("words", "items", "rarest.token", "rarest.offset", F.size("words").alias("length"))
    )
    rows = stored(
        marked_documents(docs, doc_id, text, sizes, bitmap(prefixes, settings.bits), settings), "marked"
    )

    begins = F.col("at") - F.col("offset")
    places = rows.filter("size(places) > 0").select("doc_id", "mark", "n_words", F.inline("places"))
    hits = (
        places.join(prefixes, "token")
        .withColumn("begins", begins)
        .filter((F.col("begins") >= 0) & (F.col("begins") + F.col("length") <= F.col("n_words")))
        .filter(F.slice("around", (F.col("begins") - F.col("first") + 1).cast("int"), F.col("length")) == F.col("words"))
    )
    span = F.struct(F.col("begins").alias("from"), (F.col("begins") + F.col("length")).alias("until"))
    of_docs = hits.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("items").alias("items")
    )
    found = of_docs.select(
        F.col("doc_id").alias("_id"),
        F.col("mark").alias("_mark"),
        F.col("spans"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    joined = rows.select("doc_id", "mark", "n_words").join(found, same, "left")
    return joined.select("doc_id", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def words_hit(spans) -> F.Column:
    """Words inside any of the spans, which are sorted by their beginnings."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(seen, span):
        fresh = F.greatest(F.lit(0), span["until"] - F.greatest(seen["end"], span["from"]))
        return F.struct(F.greatest(seen["end"], span["until"]).alias("end"), (seen["n"] + fresh).alias("n"))

    return F.coalesce(F.aggregate(spans, start, add)["n"], F.lit(0))


def digests(found: DataFrame) -> DataFrame:
    hit = words_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
