"""Approximate nearest neighbours by low-dimensional stable projections.

A Gaussian projection onto a few dimensions keeps distances in distribution: the squared projected distance over the squared
true one is chi-square distributed with as many degrees of freedom as dimensions. Projected points are indexed by a
kd-tree per shard; a query takes the cells in the order of their projected distance and verifies their points on the
original vectors, until a neighbour closer than the k-th so far would have shown up already with the probability `sure`.

Shards are of bounded size and chosen by the hash of the id. Every query meets every shard once, in blocks that stream
past the shard's index; a shard hands on its k best.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of different
lengths do not meet; an id given more than once counts once, by its smallest vector; fewer than k candidates are all
returned; equal distances go to the smaller id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NeighbourSettings:
    """dimensions (even) of the projection, points per cell, points per shard, and how sure the stopping test must be."""

    k: int = 10
    dimensions: int = 8
    cell: int = 32
    shard: int = 32_768
    sure: float = 0.99
    seed: int = 19


def chi_square_quantile(share: float, degrees: int) -> float:
    """For an even number of degrees, where the distribution function is a finite sum."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


class ProjectedTree:
    """A kd-tree over the projections of a shard's vectors, as boxes around its cells."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, settings: NeighbourSettings):
        self.settings, self.limit = settings, chi_square_quantile(settings.sure, settings.dimensions)
        rng = np.random.default_rng(settings.seed)
        self.matrix = rng.normal(size=(vectors.shape[1], settings.dimensions))
        points = vectors @ self.matrix
        cells, open_ = [], [np.arange(len(ids))]
        while open_:
            own = open_.pop()
            if len(own) <= settings.cell:
                cells.append(own)
                continue
            axis = int(np.ptp(points[own], axis=0).argmax())
            half = len(own) // 2
            order = np.argpartition(points[own, axis], half)
            open_ += [own[order[:half]], own[order[half:]]]
        order = np.concatenate(cells)
        self.bounds = np.cumsum([0, *map(len, cells)])
        self.ids, self.vectors = ids[order], vectors[order]
        self.low = np.minimum.reduceat(points[order], self.bounds[:-1])
        self.high = np.maximum.reduceat(points[order], self.bounds[:-1])

    def nearest(self, own_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k best found, nearest first."""
        at = query @ self.matrix
        outside = np.maximum(0, np.maximum(self.low - at, at - self.high))
        projected = (outside * outside).sum(1)
        cells = np.argsort(projected, kind="stable")
        ids, squares, k = np.zeros(0, np.int64), np.zeros(0), self.settings.k
        rounding = 1e-12 * (at @ at)  # equal vectors may be projected apart by as much
        for i in range(0, len(cells), 8):
            if len(ids) == k and projected[cells[i]] > self.limit * squares[-1] + rounding:
                break
            rows = np.concatenate([np.arange(self.bounds[c], self.bounds[c + 1]) for c in cells[i : i + 8]])
            rows = rows[self.ids[rows] != own_id]
            apart = self.vectors[rows] - query
            ids = np.concatenate([ids, self.ids[rows]])
            squares = np.concatenate([squares, (apart * apart).sum(1)])
            if len(ids) > k:
                worst = np.partition(squares, k - 1)[k - 1]
                near = squares <= worst
                ids, squares = ids[near], squares[near]
            best = np.lexsort((ids, squares))[:k]
            ids, squares = ids[best], squares[best]
        return ids, np.sqrt(squares)


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _first_of_each(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, one per id: the one with the smallest vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, vectors
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], vectors[first]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    settings: NeighbourSettings | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision); `is_query` is a condition on `vec_id`."""
    settings = settings or NeighbourSettings()
    shards = max(1, -(-vectors.count() // settings.shard))
    rows = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.size(vector).alias("size"), is_query.alias("asks")
    )
    data = rows.select("size", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "vec_id", "vector")
    single = rows.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    queries = single.select(F.size("vector").alias("size"), F.explode(every).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vector")
    dealt = data.unionByName(queries).repartition("size", "shard").sortWithinPartitions("size", "shard", "kind", "vec_id")

    def search(batches):
        at, ids, parts, tree = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if first == end:
                    continue
                size, shard, kind = keys[first]
                if at != (size, shard):
                    at, ids, parts, tree = (size, shard), [], [], None
                own = batch.slice(first, end - first)
                own_ids, own_vectors = own.column(3).to_numpy(), _matrix(own.column(4))
                if kind == 0:
                    ids.append(own_ids)
                    parts.append(own_vectors)
                    continue
                if tree is None:
                    if not ids:
                        continue
                    tree = ProjectedTree(*_first_of_each(np.concatenate(ids), np.concatenate(parts)), settings)
                    ids, parts = [], []
                asked, found, scores = [], [], []
                for own_id, query in zip(own_ids.tolist(), own_vectors, strict=True):
                    near, distances = tree.nearest(own_id, query)
                    asked.append(np.full(len(near), own_id))
                    found.append(near)
                    scores.append(distances)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (asked, found, scores)], names=["query_id", "vec_id", "score"]
                )

    best = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= settings.k).select("query_id", "rank", "vec_id", "score")
