"""Nearest neighbours against brute force."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelyard.llm import neighbours
from modelyard.llm.neighbours import NeighbourSettings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    found = []
    for q, x in rows:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(y) - x) ** 2).sum())), i) for i, y in rows if i != q and len(y) == len(x))
            found += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(near[:k])]
    return found


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    want = {(q, i) for q, _, i, _ in brute(rows)}
    for settings in (NeighbourSettings(), NeighbourSettings(shard=500)):
        found = neighbours.nearest(table, F.col("vec_id") % 100 == 0, settings).collect()
        assert len({(r["query_id"], r["vec_id"]) for r in found} & want) >= 0.9 * len(want)
        assert len(found) == len(want)


def test_stopping_test_stops():
    """Well-separated groups: most points are never looked at, and the neighbours are right."""
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(40, 1, 32)) * 30 + rng.normal(size=(40, 100, 32))).reshape(-1, 32)
    tree = neighbours.ProjectedTree(np.arange(4000), points, NeighbourSettings())
    seen, vectors = [], tree.vectors

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            seen.append(len(rows))
            return np.asarray(super().__getitem__(rows))

    tree.vectors = vectors.view(Counted)
    hits = 0
    for own in range(0, 4000, 100):
        ids, _ = tree.nearest(own, points[own])
        d = ((points - points[own]) ** 2).sum(1)
        d[own] = np.inf
        hits += len(set(ids.tolist()) & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 400 and sum(seen) < 0.5 * 40 * 4000


def test_chi_square():
    for degrees, share, want in ((2, 0.5, 1.3862943611), (8, 0.95, 15.5073130559), (6, 0.99, 16.8118938298)):
        assert abs(neighbours.chi_square_quantile(share, degrees) - want) < 1e-6


def test_hard_rows(spark):
    nan, inf = math.nan, math.inf
    good = [(i, [float(i % 7), 1.0, float(i // 50)]) for i in range(0, 400)] + [(500, [1.0, 2.0]), (501, [1.0, 2.5]), (600, [9.0])]
    bad = [(700, None), (800, []), (900, [0.0, 0.0, 0.0]), (1000, [nan, 1.0, 1.0]), (1100, [inf, 1.0, 1.0]), (1200, [1.0, None, 1.0])]
    rows = [(i, v, 1) for i, v in good + bad] + [(100, [50.0, 1.0, 1.0], 2), (100, good[100][1], 1), (None, [1.0, 1.0, 1.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rank", "2 as score", "3 as shard", "4 as kind", "'x' as vector").repartition(3)
    want = brute([(i, np.array(v)) for i, v in good])
    for settings in (NeighbourSettings(sure=0.999999), NeighbourSettings(sure=0.999999, shard=64, cell=4)):
        found = sorted(map(tuple, neighbours.nearest(table, F.col("vec_id") % 100 == 0, settings).collect()))
        assert [f[:3] for f in found] == [w[:3] for w in sorted(want)]
        assert np.allclose([f[3] for f in found], [w[3] for w in sorted(want)])


@pytest.mark.parametrize("shard", [32_768, 40])
def test_equal_vectors(spark, shard):
    """A third of all rows hold one vector; ties go to the smaller ids."""
    rng = np.random.default_rng(1)
    rows = [(i, ([1.0] * 8 if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()), 0) for i in range(600)]
    table = spark.createDataFrame(rows, SCHEMA)
    settings = replace(NeighbourSettings(), shard=shard, sure=0.999999)
    found = neighbours.nearest(table, F.col("vec_id") % 100 == 0, settings).collect()
    want = brute([(i, np.array(v)) for i, v, _ in rows])
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted(w[:3] for w in want)


def test_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
