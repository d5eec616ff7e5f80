"""Hard negatives by Fagin's threshold algorithm.

Vectors are scaled to integers and scored by their inner product with an anchor. Every shard keeps one sorted list of its
rows per dimension. A search reads each list from the end that the sign of the anchor's component favours, scores every row that
it meets for the first time on all components, and stops when the threshold, the score that a row at the lists' present
depth could have at most, has fallen strictly below what every window still needs: its k-th best score, or its lower end as
long as it holds fewer than k. So results are exact, ties included.

Positives are searched among the rows of the anchor's label only, in shards of (label, part); negatives among all rows,
those of the anchor's label left out, in parts. A large label has many parts. Anchors go to the parts once each; a part
hands on k rows per window. How many parts there are changes nothing in the result.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; vectors of
different lengths do not meet, and those without components score 0 with each other; an id given more than once counts once, by its
smallest (label, vector); a window whose ends cross is empty; fewer than k rows are all returned; equal scores go to
the smaller id; scores beyond 64 bits count as the largest long (or its negative); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelyard.session import stored

LONGEST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class NegativeSettings:
    """positives per anchor, negatives per positive, the window in percent of the positive's score, the scale of components,
    rows per part, and the depth of the first round (each reads four times as deep)."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    part: int = 131_072
    least_part: int = 4_096
    depth: int = 64


def usable(vector: Column) -> Column:
    """Not null, all components finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as doubles that are whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), size)


def _norm(rows: np.ndarray) -> float:
    """No less than the length of the longest row."""
    return float(np.sqrt((rows * rows).sum(1).max(initial=0))) * 1.001 + 1


class Best:
    """The k best rows of a window of scores: descending, equal scores by ascending id."""

    def __init__(self, low, high, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def need(self):
        """A row that scores less than this is no result."""
        return self.scores[-1] if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.need()) & (scores <= self.high))
        if not len(at):
            return
        if len(at) > 4 * self.k:  # only those no worse than the k-th can stay
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        scores, ids = np.concatenate([self.scores, scores[at]]), np.concatenate([self.ids, ids[at]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class SortedLists:
    """The rows of a part, with one list per dimension sorted by its component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, depth: int = 64):
        self.ids, self.labels, self.depth, self.norm = ids, labels, depth, _norm(rows)
        self.rows = {np.float64: rows}
        self.rising = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)
        self.falling = np.ascontiguousarray(self.rising[:, ::-1])
        self.sorted = np.take_along_axis(rows.T, self.rising, 1)

    def _kind(self, anchor: np.ndarray):
        """The narrowest numbers that hold all sums of products with the anchor exactly; its rows are made once."""
        most = self.norm * _norm(anchor[None])
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        if kind not in self.rows:
            whole = self.rows[np.float64]
            self.rows[kind] = whole.astype(np.float32) if kind is np.float32 else np.vectorize(int, otypes=[object])(whole)
        return kind

    def search(self, own_id: int, anchor: np.ndarray, windows: list[Best], other_than=None) -> int:
        """Fill the windows with rows other than the anchor's own, of a label other than `other_than`; gives the rows scored."""
        n, scored, kind = len(self.ids), 0, self._kind(anchor)
        fits = self.ids != own_id
        if other_than is not None:
            fits &= self.labels != other_than
        own = np.array([int(x) for x in anchor], object) if kind is object else anchor.astype(kind)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        unseen, depth, until = np.ones(n, bool), 0, min(self.depth, n)
        while n:
            if len(up) or len(down):
                met = np.zeros(n, bool)
                met[self.falling[up, depth:until]] = True
                met[self.rising[down, depth:until]] = True
                met &= unseen
            else:
                met = unseen.copy()  # a zero anchor has no lists to read
            unseen ^= met
            fresh = np.flatnonzero(met & fits)
            scored += len(fresh)
            scores, ids = self.rows[kind][fresh] @ own, self.ids[fresh]
            if kind is object:
                scores = np.array([max(-LONGEST, min(LONGEST, int(x))) for x in scores], np.int64)
            scores = scores.astype(np.int64)
            near = scores >= min(window.need() for window in windows)
            for window in windows:
                window.add(scores[near], ids[near])
            if not unseen.any():
                break
            threshold = own[up] @ self.sorted[up, n - 1 - until].astype(own.dtype) + own[down] @ self.sorted[down, until].astype(own.dtype)
            if all(self._rounded_up(threshold, kind, anchor) < window.need() for window in windows):
                break
            depth, until = until, min(4 * until, n)
        return scored

    def _rounded_up(self, threshold, kind, anchor: np.ndarray):
        """The threshold adds the largest components of different rows, so that its sum may be beyond what is exact."""
        largest = float(np.abs(anchor).sum()) * self.norm
        exact = {np.float32: 1 << 24, np.float64: 1 << 53}.get(kind, float("inf"))
        return threshold if largest < exact else float(threshold) + largest * (1e-5 if kind is np.float32 else 1e-12)


def prepared(vectors: DataFrame, is_anchor: Column, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, vector, size, anchor: one row per id."""
    rows = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull() & F.col(label).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"), is_anchor.alias("anchor")
    )
    single = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row"))
    return single.select("vec_id", "row.label", "row.vector", F.size("row.vector").alias("size"), F.coalesce("row.anchor", F.lit(False)).alias("anchor"))


def _searched(dealt: DataFrame, settings: NegativeSettings, windows, positives: bool, label_kind: str) -> DataFrame:
    """Run the anchors (kind 1) of every (size, group, part) against its rows (kind 0), which come first."""
    scale, depth = settings.scale, settings.depth

    def search(batches):
        at, gathered, lists = None, [], None
        for batch in batches:
            sizes, parts, kinds = (batch.column(c).to_numpy() for c in ("size", "part", "kind"))
            coded = batch.column("group").dictionary_encode("encode").indices.to_numpy()
            change = (np.diff(sizes) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0) | (np.diff(coded) != 0)
            cuts = (np.flatnonzero(change) + 1).tolist()
            for first, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if first == end:
                    continue
                own, size = batch.slice(first, end - first), int(sizes[first])
                key = size, own.column("group")[0].as_py(), int(parts[first])
                if key != at:
                    at, gathered, lists = key, [], None
                rows = scaled(own.column("vector"), size, scale)
                # Labels are only compared within a part.
                if kinds[first] == 0:
                    gathered.append((own.column("vec_id").to_numpy(), own.column("label"), rows))
                    continue
                if lists is None:
                    if not gathered:
                        continue
                    known = pa.concat_arrays([g[1] for g in gathered]).dictionary_encode()
                    names = {name: i for i, name in enumerate(known.dictionary.to_pylist())}
                    lists = SortedLists(
                        np.concatenate([g[0] for g in gathered]), known.indices.to_numpy(), np.concatenate([g[2] for g in gathered]), depth
                    )
                    gathered = []
                asked, of, of_score, found, scores = [], [], [], [], []
                anchors = zip(own.column("vec_id").to_pylist(), own.column("label").to_pylist(), rows, own.column("windows").to_pylist(), strict=True)
                for own_id, label, anchor, wanted in anchors:
                    bests = windows(wanted)
                    open_ = [best for _, best in bests if best.low <= best.high]
                    if open_:
                        lists.search(own_id, anchor, open_, None if positives else names.get(label, -1))
                    for (positive, score), best in ((w, b) for w, b in bests):
                        asked += [own_id] * len(best.ids)
                        of += [positive] * len(best.ids)
                        of_score += [score] * len(best.ids)
                        found.append(best.ids)
                        scores.append(best.scores)
                none = [np.zeros(0, np.int64)]
                columns = [pa.array(x, pa.int64()) for x in (asked, of, of_score, np.concatenate(none + found), np.concatenate(none + scores))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "positive_score", "found_id", "score"])

    columns = ["size", "group", "part", "kind", "vec_id", "label", "vector", "windows"]
    sorted_ = dealt.select(*columns).repartition("size", "group", "part").sortWithinPartitions("size", "group", "part", "kind", "vec_id")
    return sorted_.mapInArrow(search, "anchor_id long, positive_id long, positive_score long, found_id long, score long")


def _parts(n: Column, settings: NegativeSettings, tasks: int) -> Column:
    """Parts for n rows: as many as memory asks for, and where rows suffice as many as keep all tasks busy."""
    few = F.least(F.lit(tasks).cast("long"), F.ceil(n / settings.least_part))
    return F.greatest(F.ceil(n / settings.part), few, F.lit(1).cast("long"))


WINDOWS = "array<struct<positive_id:bigint,positive_score:bigint>>"


def mined(
    vectors: DataFrame,
    is_anchor: Column,
    settings: NegativeSettings | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score."""
    settings = settings or NegativeSettings()
    rows = stored(prepared(vectors, is_anchor, vec_id, vector, label), "vectors")
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    place = F.xxhash64("vec_id", F.lit(7))
    no_windows = F.lit(None).cast(WINDOWS).alias("windows")
    kind = rows.schema["label"].dataType.simpleString()

    # Positives: rows of a label in parts; the anchors of the label meet each of them.
    of_label = rows.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"), F.max("anchor").alias("asked")).filter("asked")
    counted = of_label.select("label", "size", _parts(F.col("n"), settings, tasks).alias("parts"))
    placed = rows.join(counted, ["label", "size"]).withColumn("group", F.col("label"))
    data = placed.withColumn("part", F.pmod(place, "parts")).withColumn("kind", F.lit(0)).withColumn("windows", no_windows)
    asks = placed.filter("anchor").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asks = asks.withColumn("kind", F.lit(1)).withColumn("windows", no_windows)

    def nearest(_):
        return [((None, None), Best(-LONGEST, LONGEST, settings.positives))]

    found = _searched(data.unionByName(asks), settings, nearest, True, kind)
    best_first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    positives = found.withColumn("nth", F.row_number().over(best_first)).filter(F.col("nth") <= settings.positives)
    pairs = F.array_sort(F.collect_list(F.struct("nth", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))))
    of_anchor = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(pairs.alias("windows"))
    windows_of = F.transform("windows", lambda w: F.struct(w["positive_id"].alias("positive_id"), w["positive_score"].alias("positive_score")))
    anchors = stored(
        rows.join(of_anchor, "vec_id").select("vec_id", "label", "vector", "size", windows_of.alias("windows")), "anchors"
    )

    # Negatives: all rows in parts; every anchor meets each of them.
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", _parts(F.col("n"), settings, tasks).alias("parts"))
    group = F.lit(None).cast(kind)
    data = rows.join(sizes, "size").withColumn("part", F.pmod(place, "parts")).withColumn("kind", F.lit(0)).withColumn("windows", no_windows)
    asks = anchors.join(sizes, "size").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = data.drop("anchor").unionByName(asks.withColumn("kind", F.lit(1))).withColumn("group", group)

    def below(wanted):
        found = []
        for w in wanted:
            score = w["positive_score"]
            low, high = -(-settings.low * score // 100), settings.high * score // 100
            found.append(((w["positive_id"], score), Best(low, high, settings.negatives)))
        return found

    found = _searched(both, settings, below, False, kind)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "found_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
