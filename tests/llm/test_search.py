"""Ranked search against a loop over all documents and items."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from modelyard.llm import search
from modelyard.llm.search import SearchSettings

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    own = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, length = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    wanted = defaultdict(Counter)
    for item, text in set(items):
        wanted[item].update(terms(text))
    found = []
    for item, asked in wanted.items():
        scores = []
        for doc_id, words in own:
            tf, score = Counter(words), 0
            for term, times in asked.items():
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 75 + (25 * len(words) * n_docs) // length
                    score += times * w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k])]
    return sorted(found, key=repr)


def ranked(docs, items, settings=None):
    return sorted(map(tuple, search.ranked(docs, items, settings).collect()), key=repr)


SETTINGS = [SearchSettings(), SearchSettings(postings=5, cells=7), SearchSettings(postings=200, cells=1 << 12, k=3)]


@pytest.mark.parametrize("settings", SETTINGS)
def test_hard_rows(spark, hard, hard_rows, settings):
    texts = [r[1] for r in hard_rows]
    items = [(1, None), (2, ""), (3, "!!"), (4, texts[5][:200]), (4, texts[5][:200]), (4, texts[10][:90]), (5, "ONE word 12 34"), (6, "absent"), (None, "x")]
    items += [(7, "日本 日本 x"), (8, texts[10]), (9, "word" * 200_000)] + [(20 + i, texts[20 + i]) for i in range(20)]
    table = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as term", "2 as times", "3 as block", "4 as item", "5 as score").repartition(2)
    found = ranked(hard, table, settings)
    assert found == brute([(r[0], r[1]) for r in hard_rows], items, settings.k)
    assert {f[0] for f in found} >= {4, 5, 7, 8, 9, None}


@pytest.mark.parametrize("settings", SETTINGS[:2])
def test_documents(spark, documents, sf, settings):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert ranked(documents.repartition(7), items, settings) == want


def test_ties_and_copies(spark):
    """A third of the documents are one text: the smallest ids win, whatever the task."""
    docs = [(i, "alpha beta" if i % 3 == 0 else f"word{i} alpha gamma" if i % 3 == 1 else "delta") for i in range(300)][::-1]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    items = [(1, "alpha beta"), (2, "beta beta beta"), (3, "gamma")]
    found = ranked(table, spark.createDataFrame(items, ITEMS))
    assert found == brute(docs, items)
    assert [f[2] for f in sorted(found, key=lambda f: f[:2]) if f[0] == 1] == list(range(0, 60, 3))


def test_empty(spark, empty, hard):
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "one")], ITEMS)
    assert ranked(hard, none) == ranked(empty, one) == ranked(empty, none) == []


def test_heaps_hold_the_best_of_any_order():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 40, size=(500, 3)), rng.permutation(500)
    heaps = search.Heaps(3, 7)
    for begin in range(0, 500, 37):
        heaps.add(scores[begin : begin + 37], ids[begin : begin + 37])
    for item in range(3):
        best = np.lexsort((ids, -scores[:, item]))[:7]
        assert heaps.ids[item].tolist() == ids[best].tolist() and heaps.scores[item].tolist() == scores[best, item].tolist()


def test_scores_beyond_doubles():
    """The sums of a block whose bound passes 2^53 are added as integers."""
    block = search.Block(np.array([1, 1, 2], np.uint64), np.array([0, 1, 0]), np.array([1 << 30, 3, 1]))
    row, place, worth = np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([(1 << 31) + 1, 5, 7])
    assert search.scored(block, 2, 2, row, place, worth).tolist() == [[((1 << 31) + 1 << 30) + 5, 3 * ((1 << 31) + 1)], [7 << 30, 21]]


def test_runs_of_documents():
    assert list(search.in_reach(np.array([3, 3, 9, 0, 0]), 2, 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(search.in_reach(np.array([1, 1]), 100, 6)) == [(0, 1), (1, 2)]
