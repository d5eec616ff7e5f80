"""Hard negatives against brute force, and the threshold test."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelyard.llm import negatives
from modelyard.llm.negatives import Best, NegativeSettings, SortedLists

SCHEMA = "vec_id long, embedding array<float>, label int"
TINY = NegativeSettings(part=40, least_part=8, depth=4)


def clipped(score):
    return max(-negatives.LONGEST, min(negatives.LONGEST, score))


def brute(rows, settings=NegativeSettings()):
    """rows: (id, floats, label), one per id."""
    whole = {i: ([math.floor(settings.scale * x) for x in v], label) for i, v, label in rows}
    found = []
    for a, (va, la) in whole.items():
        if a % 50:
            continue
        scores = [(-clipped(sum(x * y for x, y in zip(va, v))), i, label) for i, (v, label) in whole.items() if i != a and len(v) == len(va)]
        for minus, p, _ in sorted(s for s in scores if s[2] == la)[: settings.positives]:
            score = -minus
            window = sorted(s for s in scores if s[2] != la and settings.low * score <= -100 * s[0] <= settings.high * score)
            found += [(a, p, rank + 1, i, score, -m) for rank, (m, i, _) in enumerate(window[: settings.negatives])]
    return sorted(found)


def mined(table, settings):
    return sorted(map(tuple, negatives.mined(table, F.col("vec_id") % 50 == 0, settings).collect()))


@pytest.mark.parametrize("settings", [NegativeSettings(), TINY, replace(TINY, positives=2, negatives=1, low=10, high=80)])
def test_clustered_rows(spark, settings):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(4, 16))
    rows = [(i, (centers[i % 4] + rng.normal(size=16)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert mined(table, settings) == brute(rows, settings) != []


@pytest.mark.parametrize("settings", [NegativeSettings(), TINY])
def test_hard_rows(spark, settings):
    nan, inf = math.nan, math.inf
    good = [(i, [float(i % 5) / 4, 1.0, -float(i // 90)], i % 3) for i in range(0, 400)]
    good += [(450, [0.0, 0.0, 0.0], 1), (500, [1.0, 2.0], 1), (501, [1.0, 2.5], 1), (502, [0.5, 1.5], 2), (550, [], 0), (551, [], 0), (552, [], 1)]
    good += [(600, [1.0] * 4, 7), (650, [1e9] * 5, 1), (651, [2e9] * 5, 1), (652, [1.5e9] * 5, 2), (653, [1.1e9, 1.0, 0.3, 1e9, -5.0], 3)]
    bad = [(700, None, 1), (750, [nan, 1.0, 1.0], 1), (800, [inf, 1.0, 1.0], 1), (850, [1.0, None, 1.0], 1), (900, [1.0, 1.0, 1.0], None)]
    again = [good[100], good[100], (None, [1.0, 1.0, 1.0], 1)]
    table = spark.createDataFrame(good + bad + again, SCHEMA).selectExpr(
        "*", "1 as anchor", "2 as part", "'x' as windows", "3 as kind", "4 as size", "5 as score", "6 as found_id", "7 as parts"
    )
    assert mined(table.repartition(3), settings) == brute(good, settings)


@pytest.mark.parametrize("size", [1e6, 3e7, 1e12])
def test_scores_beyond_doubles(spark, size):
    """Sums beyond 2^53 are exact, those beyond 64 bits count as the largest long."""
    rng = np.random.default_rng(3)
    rows = [(i, (size * (1 + rng.random(4))).astype(np.float32).tolist(), i % 2) for i in range(120)]
    assert mined(spark.createDataFrame(rows, SCHEMA), TINY) == brute(rows, TINY)


def test_equal_vectors(spark):
    """A third of all rows hold one vector and one label; ties go to the smaller ids."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 8 if i % 3 else rng.normal(size=8).astype(np.float32).tolist(), 1 if i % 3 == 1 else 2) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert mined(table, TINY) == brute(rows, TINY) == mined(table, NegativeSettings())


def test_smallest_row_of_an_id(spark):
    rows = [(0, [1.0], 1), (0, [2.0], 0), (1, [1.0], 0), (2, [1.2], 1), (3, [0.9], 1)]
    want = brute([(0, [2.0], 0), *rows[2:]])
    assert mined(spark.createDataFrame(rows, SCHEMA), TINY) == want


def test_threshold_stops():
    """Few large components decide: most rows are never scored, and the best are right."""
    rng = np.random.default_rng(8)
    rows = np.floor(256 * rng.exponential(size=(20_000, 6)) ** 3)
    lists = SortedLists(np.arange(20_000), np.zeros(20_000, int), rows)
    seen = 0
    for anchor in np.floor(50 * rng.normal(size=(40, 6))):
        best = Best(-negatives.LONGEST, negatives.LONGEST, 5)
        seen += lists.search(-1, anchor, [best])
        scores = (rows @ anchor).astype(int)
        assert best.ids.tolist() == np.lexsort((np.arange(20_000), -scores))[:5].tolist()
    assert seen < 0.5 * 40 * 20_000


def test_ties_at_the_threshold():
    """The threshold must fall strictly below the k-th score: an unseen row with the same score and a smaller id wins."""
    rows = np.array([[1.0, 0.0]] * 50 + [[0.0, 1.0]] * 50)
    ids = np.arange(100)[::-1].copy()
    best = Best(-negatives.LONGEST, negatives.LONGEST, 3)
    SortedLists(ids, np.zeros(100, int), rows, depth=1).search(-1, np.array([1.0, 1.0]), [best])
    assert best.ids.tolist() == [0, 1, 2]


def test_empty(spark):
    assert mined(spark.createDataFrame([], SCHEMA), NegativeSettings()) == []
