"""Benchmark windows in documents, against a search word by word."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from modelyard.llm import decontaminate
from modelyard.llm.decontaminate import WindowSettings


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    cut = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            cut.setdefault(tuple(own[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in cut}
    found = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in cut:
                    hit |= set(range(i, i + size))
                    names |= cut[tuple(own[i : i + size])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found.append((doc, len(own), len(hit), len(names), digest, bool(hit)))
    return sorted(found, key=repr)


def result(docs, items, settings=None):
    return sorted(map(tuple, decontaminate.digests(decontaminate.contamination(docs, items, settings)).collect()), key=repr)


@pytest.fixture(scope="module")
def items(hard_rows):
    by = {r[0]: (r[1] or "").split() for r in hard_rows}
    long = by[10]
    return [
        (1, " ".join(long[5:40])), (2, " ".join(long[30:45])), (10, " ".join(long[5:17])), (3, "one"), (4, "12, 34"), (5, None), (6, ""),
        (7, "!! .."), (8, " ".join(by[6][:9])), (9, " ".join(by[6][:10]).upper()), (None, " ".join(long[100:112])), (2, " ".join(by[100])),
        (11, " ".join(long[:10])), (12, " ".join(long[-10:])), (13, "the " * 12), (14, "日本 語 x"),
    ]


@pytest.mark.parametrize("settings", [WindowSettings(), WindowSettings(bits=8), WindowSettings(window=4, shingle=2)])
def test_hard_rows(spark, hard, hard_rows, items, settings):
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as token", "'x' as words", "2 as n")
    assert result(hard, table, settings) == brute([r[:2] for r in hard_rows], items, settings.window)


def test_repeating_words(spark):
    """Windows of equal words, overlapping occurrences, and passages at either end."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))) for i in range(20)] + [(99, "a " * 30)]
    found = result(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found == brute(docs, items)


def test_empty_sides(spark, empty, hard, hard_rows, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(hard, none) == brute([r[:2] for r in hard_rows], [])
    assert result(empty, spark.createDataFrame(items, "item_id long, text string")) == []
