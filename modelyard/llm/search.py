"""Ranked lexical search the other way round: documents stream past an inverted index of the items' terms.

The index over the items' terms (postings: term, item, how often) is sent to all tasks, in blocks of bounded size. A first pass
over the documents counts N, L and the document frequencies of the items' terms; the weights follow from these. In a
second pass every document's term counts run through the postings, and each task keeps, per item, a heap of the best
documents that it has seen. Heaps are merged in two steps, so that no task gets those of all others. Texts never move.

All arithmetic after the logarithm is exact: products and sums are 64-bit integers, or doubles where a bound shows that they
stay below 2^53.

Defined cases: null and empty texts, and texts without terms, have no terms and are not counted in N; items without terms have no
results; items that share an id are one item with the terms of all its different texts, equal rows counting once;
a null item id is an id; documents are rows: those that share an id rank side by side, and a null doc_id comes last among
equal scores; an empty table on either side gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelyard.llm.bytewords import WordHasher, letters_and_digits
from modelyard.session import pinned

#: What a null doc_id is while heaps compare integers; no id of a table should have this value.
NO_ID = np.iinfo(np.int64).max
EXACT = 1 << 53


@dataclass(frozen=True)
class SearchSettings:
    """k results per item; length_share and scale: how a document's length counts; postings: the most of a block of items
    (a single item may have more); cells: the most of scores and of postings that documents touch at a time."""

    k: int = 20
    length_share: int = 25
    saturation: int = 12
    postings: int = 1_000_000
    cells: int = 1 << 22


def _longs(array: np.ndarray) -> pa.Array:
    return pa.array(array.view(np.int64))


def postings_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, term (a hash), times."""

    def cut(batches):
        hasher = WordHasher(letters_and_digits())
        for batch in batches:
            rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, words, bounds in hasher.runs(batch.column("text")):
                rows.append(first + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
                terms.append(words)
            ids = batch.column("item_id").take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([ids, _longs(np.concatenate(terms))], names=["item_id", "term"])

    kind = items.schema[item_id].dataType.simpleString()
    single = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    found = single.mapInArrow(cut, f"item_id {kind}, term long")
    return found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def in_blocks(postings: DataFrame, most: int) -> DataFrame:
    """The postings with the number of their item's block, 0 to blocks - 1; blocks are checked to hold `most` at the most.

    Blocks are dealt by hash, and their number grows until no block is too large or every too large one is one item.
    """
    total = postings.count()
    blocks = max(1, -(-total // most))
    while True:
        dealt = postings.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
        large = dealt.groupBy("block", "item_id").count().groupBy("block").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("items"))
        if blocks >= max(1, total) or large.filter(f"n > {most} and items > 1").isEmpty():
            return dealt
        blocks *= 2


class Block:
    """The postings of a block of items as arrays: sorted terms, and for each the run of its items and their repeats."""

    def __init__(self, terms: np.ndarray, items: np.ndarray, times: np.ndarray):
        order = np.lexsort((items, terms))
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(terms)).astype(np.int64)
        self.items, self.times = items[order], times[order]

    def found(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the term, times) of the terms of the block that the rows hold."""
        if not len(self.terms) or not len(words):
            return (np.zeros(0, np.int64),) * 3
        place = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        at = np.flatnonzero(self.terms[place] == words)
        row = np.searchsorted(bounds, at, "right") - 1
        pairs, times = np.unique(row * len(self.terms) + place[at], return_counts=True)
        return pairs // len(self.terms), pairs % len(self.terms), times


def corpus_counts(docs: DataFrame, text: str, sent: list) -> tuple[int, int, list[np.ndarray]]:
    """N, L and the document frequencies of every block's terms; tasks hand on sums, one row per term that they have seen."""

    def count(batches):
        hasher, blocks = WordHasher(letters_and_digits()), [Block(*b.value) for b in sent]
        with_terms, length, seen = 0, 0, [np.zeros(len(b.terms), np.int64) for b in blocks]
        for batch in batches:
            for _, words, bounds in hasher.runs(batch.column(0)):
                sizes = np.diff(bounds)
                with_terms += int((sizes > 0).sum())
                length += int(sizes.sum())
                for block, own in zip(blocks, seen, strict=True):
                    own += np.bincount(block.found(words, bounds)[1], minlength=len(block.terms))
        held = [np.flatnonzero(own) for own in seen]
        numbers = np.concatenate([[-1, -1], *[np.full(len(h), i) for i, h in enumerate(held)]]).astype(np.int32)
        places = np.concatenate([[0, 1], *held]).astype(np.int64)
        counts = np.concatenate([[with_terms, length], *[own[h] for own, h in zip(seen, held, strict=True)]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(places), pa.array(counts)], names=["block", "place", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "block int, place long, n long")
    sums = found.groupBy("block", "place").agg(F.sum("n").alias("n")).toArrow()
    block, place, n = (sums.column(c).to_numpy() for c in ("block", "place", "n"))
    whole = dict(zip(place[block < 0].tolist(), n[block < 0].tolist(), strict=True))
    frequencies = []
    for i, b in enumerate(sent):
        own = np.zeros(len(np.unique(b.value[0])), np.int64)
        own[place[block == i]] = n[block == i]
        frequencies.append(own)
    return whole.get(0, 0), whole.get(1, 0), frequencies


def weights(documents: int, frequencies: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of each term."""
    return np.array([floor(1000 * log((2 * documents + 2) / (2 * df + 1))) for df in frequencies.tolist()], np.int64)


class Heaps:
    """The k best documents of every item: scores in descending order, equal ones by ascending id."""

    def __init__(self, items: int, k: int):
        self.k, self.scores, self.ids = k, np.zeros((items, k), np.int64), np.full((items, k), NO_ID)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[document, item]; scores of 0 are no results."""
        least = self.scores[:, -1]
        row, item = np.nonzero((scores >= np.maximum(least, 1)) & ((scores > least) | (ids[:, None] < self.ids[:, -1])))
        if not len(row):
            return
        changed = np.unique(item)
        # What the changed heaps hold and what comes to them, sorted once; the first k of each item stay.
        all_items = np.concatenate([np.repeat(changed, self.k), item])
        all_scores = np.concatenate([self.scores[changed].ravel(), scores[row, item]])
        all_ids = np.concatenate([self.ids[changed].ravel(), ids[row]])
        order = np.lexsort((all_ids, -all_scores, all_items))
        starts = np.searchsorted(all_items[order], changed)
        best = order[starts[:, None] + np.arange(self.k)]
        self.scores[changed], self.ids[changed] = all_scores[best], all_ids[best]


def in_reach(touched: np.ndarray, items: int, cells: int) -> Iterator[tuple[int, int]]:
    """Runs of documents (first, end) that touch at most `cells` postings and fill as many cells of scores, or one document."""
    total, first = np.concatenate([[0], np.cumsum(touched)]), 0
    while first < len(touched):
        end = int(np.searchsorted(total, total[first] + cells, "right")) - 1
        end = max(first + 1, min(end, first + cells // items, len(touched)))
        yield first, end
        first = end


def contributions(weight: np.ndarray, place, times, damping) -> np.ndarray:
    """What a document's term adds to the score of an item that holds it once."""
    return weight[place] * ((1_000_000_000 * times) // (1000 * times + damping))


def scored(block: Block, items: int, rows: int, row: np.ndarray, place: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """scores[document, item] of some documents, given their terms' worth."""
    size = np.diff(block.starts)[place]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(block.starts[place] - (ends - size), size)
    cell = np.repeat(row * items, size) + block.items[at]
    added = np.repeat(worth, size) * block.times[at]
    if float(worth.max(initial=0)) * float(block.times.max(initial=0)) * max(1, len(at)) < EXACT:
        return np.bincount(cell, added, rows * items).astype(np.int64).reshape(rows, items)
    total = np.zeros(rows * items, np.int64)
    np.add.at(total, cell, added)
    return total.reshape(rows, items)


def best_documents(docs: DataFrame, doc_id: str, text: str, sent, weight, items: int, documents: int, length: int, settings: SearchSettings):
    """item (number within its block), doc_id, score: every task's heaps, with the number of one of 64 groups of tasks."""
    share, damp = settings.length_share, settings.saturation

    def search(batches):
        hasher, block, heaps = WordHasher(letters_and_digits()), Block(*sent.value), Heaps(items, settings.k)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for first, words, bounds in hasher.runs(batch.column("text")):
                row, place, times = block.found(words, bounds)
                damping = damp * (100 - share + (share * np.diff(bounds) * documents) // max(1, length))
                worth = contributions(weight.value, place, times, damping[row])
                for begin, end in in_reach(np.bincount(row, np.diff(block.starts)[place], len(bounds) - 1), items, settings.cells):
                    at = slice(*np.searchsorted(row, [begin, end]))
                    scores = scored(block, items, end - begin, row[at] - begin, place[at], worth[at])
                    heaps.add(scores, ids[first + begin : first + end])
        item, rank = np.nonzero(heaps.scores)
        found = pa.array(heaps.ids[item, rank], mask=heaps.ids[item, rank] == NO_ID)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int64)), found, pa.array(heaps.scores[item, rank])], names=["item", "doc_id", "score"]
        )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = chosen.mapInArrow(search, "item long, doc_id long, score long")
    return found.withColumn("tasks", F.spark_partition_id() % 64)


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    settings: SearchSettings | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of each item with the highest scores above 0."""
    settings = settings or SearchSettings()
    spark = docs.sparkSession
    dealt = pinned(in_blocks(postings_of(items, item_id, item_text), settings.postings))
    sent, names = [], []
    for number in sorted(row[0] for row in dealt.select("block").distinct().collect()):
        own = dealt.filter(F.col("block") == number).toArrow().combine_chunks()
        coded = own.column("item_id").combine_chunks().dictionary_encode("encode")
        arrays = own.column("term").to_numpy().view(np.uint64), coded.indices.to_numpy().astype(np.int64), own.column("times").to_numpy()
        sent.append(spark.sparkContext.broadcast(arrays))
        names.append(pa.table([pa.array(np.arange(len(coded.dictionary))), coded.dictionary], names=["item", "item_id"]))
    kind = items.schema[item_id].dataType.simpleString()
    if not sent:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    documents, length, frequencies = corpus_counts(docs, text, sent)
    parts = []
    for block, own, df in zip(sent, names, frequencies, strict=True):
        weight = spark.sparkContext.broadcast(weights(documents, df))
        heaps = best_documents(docs, doc_id, text, block, weight, len(own), documents, length, settings)
        merged = _first(_first(heaps, ["item", "tasks"], settings.k), ["item"], settings.k)
        named = F.broadcast(spark.createDataFrame(own).withColumn("item_id", F.col("item_id").cast(kind)))
        parts.append(merged.join(named, "item").select("item_id", "rank", "doc_id", "score"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
