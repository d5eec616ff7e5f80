"""Exact similarity join of word shingles by parity sketches.

Every set is cut into segments by the leading bits of its elements' hashes, and the hashes of a segment are XORed. An element
that only one of two sets holds changes one segment, so the number of segments that differ never exceeds the symmetric
difference of the sets. Sets of a size band that are similar enough have a symmetric difference of at most D, so that of more
than D segments at least one is equal: an equi-join on (band, segment, XOR) finds every pair that may be similar, and the pairs
are verified on the shingles themselves, after a second sketch of 2,048 parity bits, whose Hamming distance is a lower bound of
the difference too, has ruled out most of them. Bands are such that similar sets lie in the same band or in neighbouring ones.

Equal sets are one class throughout, and classes are the nodes: ids enter only at the end. Keys are counted in rounds, a part
of them at a time, together with a signature of their members; of keys that the same classes share (most keys of two near copies
are such) one stays. Groups of classes that share a key are not expanded into pairs: the class that shares most keys with
others, in the group or in those that its members are in, too, is their center, and all members are compared with it, so that
the groups of a set of copies have few centers between them. Let E(u) be the symmetric
difference of u and its center. Then that of u and v is the symmetric difference of E(u) and E(v); if it is no larger than
the largest that links u and v although E(u) and E(v) have nothing in common, then both u and v link with the center (the
bound grows by less than the size does). So members that are in different components after the comparison with the
center link only if they share elements of E, and a prefix-filtered join on the rarest elements of E finds those pairs: one of
the two is not near to the center, so that they share more than half of what the other differs in (`apart`).
Two large components that share such elements (a page and its second edition, with
many near copies each) are not joined member by member: their members are compared with one member of the other
component, and only those that are near enough to it can have a link across (`border`).
In groups of up to SMALL members the remaining pairs are few enough to be compared as they are.
Components are exact, and a group of copies costs about as many comparisons as it has members.

Defined cases: null and empty texts, and texts without words, have no shingles and link with nothing; fewer words than a shingle
has are one shingle; rows that share an id are one document, whatever their texts; a row without an id links like any other and
gets the component of what it links with, null if none of that has an id; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelyard.llm.bytewords import WordHasher, between_spaces, mixed, shingled
from modelyard.llm.components import components
from modelyard.llm.removal import small_side, told_apart
from modelyard.session import Scratch, pinned, release


#: Members of groups up to this size are compared with each other, those of larger ones by what they differ in from the center.
SMALL = 16
#: Keys are dealt into so many parts, which are counted one after the other where there are many keys, so that the shuffle of a
#: part, or of a few parts with so many keys together, is what lies on the disks at a time.
ROUNDS = 8
AT_A_TIME = 8_000_000
#: How many groups away from a group its center may be.
HOPS = 2
#: Pairs of components are joined member by member up to so many times as many pairs as they have members.
EVEN = 4


@dataclass(frozen=True)
class JaccardSettings:
    """words: per shingle. percent: documents link when 100 * intersection >= percent * union. bits: places of the bitmap."""

    words: int = 5
    percent: int = 80
    bits: int = 1 << 24


class Bands:
    """Size bands and their numbers of segments, worked out as far as sizes go."""

    def __init__(self, percent: int):
        self.percent, self.lows, self.spaces = percent, [1], []

    def _grow(self) -> None:
        p, low = self.percent, self.lows[-1]
        self.lows.append(100 * low // p + 1)
        high = self.lows[-1] - 1
        most = (high + 100 * high // p) * (100 - p) // (100 + p)
        # Empty segments say nothing; room for as many as the smallest set of the band is likely to have.
        for segments in range(most + 1, 3 * (most + 1) // 2 + 1):
            empty = segments * exp(-low / segments)
            if segments - empty - 2 * sqrt(empty) >= most + 1:
                break
        self.spaces.append((most, segments))

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(space, largest symmetric difference, segments) of the spaces where sets of this size meet others.

        Space i joins sets of band i with each other and with those of band i + 1. A space without room for any
        difference needs no join, as equal sets are one class already.
        """
        while len(self.spaces) < 1 or self.lows[-1] <= size:
            self._grow()
        band = int(np.searchsorted(self.lows, size, "right")) - 1
        return [(i, *self.spaces[i]) for i in (band - 1, band) if i >= 0 and self.spaces[i][0] > 0]


def sketch(elements: np.ndarray, space: int, most: int, segments: int) -> np.ndarray:
    """Join keys of a sorted set of hashes: one per segment that holds something.

    A set with so many empty segments that the rest might all differ also gives keys for its empty ones. The last bit of
    a key tells whether the number of the space is odd.
    """
    at = ((elements >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    parity = np.bitwise_xor.reduceat(mixed(elements + np.uint64(space)), starts)
    held = at[starts]
    place = mixed((np.uint64(space) << np.uint64(32)) + held)
    keys = mixed(parity ^ place)
    if len(held) <= most:
        empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), held)
        keys = np.concatenate([keys, mixed(~mixed((np.uint64(space) << np.uint64(32)) + empty))])
    return (keys & ~np.uint64(1)) | np.uint64(space & 1)


def least_shared(elements: np.ndarray, most: int, segments: int) -> int:
    """How many keys a set shares in a space with any set that it links with, at least: of the segments that hold something at most
    `most` differ. A set that gives keys for empty segments, too, may meet one that does not."""
    at = ((elements >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    return max(1, 1 + int((at[1:] != at[:-1]).sum()) - most)


BITS = 2048


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """A bit sketch: every element flips one of 2,048 bits, so that the bits in which two sketches differ are at most the
    elements in which their sets do."""
    odd = np.bincount((elements & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketched(docs: DataFrame, settings: JaccardSettings, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (the class: equal for equal sets), keys (the segments, by part), need (how many it shares at
    least, in even and odd spaces), bits (the bit sketch)."""

    def build(batches):
        hasher, bands = WordHasher(between_spaces()), Bands(settings.percent)
        for batch in batches:
            sizes, s1, s2, keys, needs, bits = [], [], [], [], [], []
            for words in hasher.rows(batch.column("text")):
                own = np.unique(shingled(words, settings.words))
                sizes.append(len(own))
                s1.append(int(mixed(own).sum(dtype=np.uint64)) if len(own) else 0)
                s2.append(int(np.bitwise_xor.reduce(mixed(~own))) if len(own) else 0)
                spaces = bands.of(len(own)) if len(own) else []
                found, need = [sketch(own, *space) for space in spaces], [0, 0]
                for number, most, segments in spaces:
                    need[number & 1] = least_shared(own, most, segments)
                needs += need
                held = np.concatenate(found) if found else np.zeros(0, np.uint64)
                in_round = held % np.uint64(ROUNDS)
                keys += [held[in_round == i] for i in range(ROUNDS)]
                bits.append(parity_bits(own) if found else np.zeros(0, np.uint64))
            ends = np.arange(0, len(keys) + 1, ROUNDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(s1, np.uint64).view(np.int64)),
                    pa.array(np.array(s2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), _lists(keys)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(needs) + 1, 2, dtype=np.int32)), pa.array(needs, pa.int32())),
                    _lists(bits),
                ],
                names=["doc_id", "n_shingles", "s1", "s2", "keys", "need", "bits"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    result = f"doc_id {kind}, n_shingles long, s1 long, s2 long, keys array<array<long>>, need array<int>, bits array<long>"
    return chosen.mapInArrow(build, result)


def shingle_sets(docs: DataFrame, wanted: DataFrame, settings: JaccardSettings, doc_id: str, text: str) -> DataFrame:
    """node, elements: the shingles of the documents in `wanted`."""

    def build(batches):
        hasher = WordHasher(between_spaces())
        for batch in batches:
            own = [np.unique(shingled(words, settings.words)) for words in hasher.rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(own)], names=["node", "elements"])

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text"))
    kept = chosen.join(small_side(wanted), "node", "left_semi")
    return kept.mapInArrow(build, f"node {kind}, elements array<long>")


def one_key_per_set(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """key, members, weight: of the keys that several nodes share, one for each set of nodes and how many keys it stands for;
    `segments` has node and keys by part. Keys of even and of odd spaces are kept apart.

    The signature of a set, its size and two XORs of hashes of its members, is added up before the shuffle.
    """
    total = segments.agg(F.sum(F.aggregate("keys", F.lit(0).cast("long"), lambda n, own: n + F.size(own)))).first()[0] or 0
    parts = max(1, min(ROUNDS, ROUNDS * AT_A_TIME // max(1, total)))
    rounds = []
    for first in range(0, ROUNDS, parts):
        rows = segments.select("node", F.explode(F.flatten(F.slice("keys", first + 1, parts))).alias("key"))
        marks = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(f"mark{salt}") for salt in (1, 2)]
        counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *marks)
        rounds.append(scratch.stored(counted.filter("members > 1"), "keys"))
        if parts < ROUNDS:
            release(segments.sparkSession)
    shared = rounds[0]
    for more in rounds[1:]:
        shared = shared.unionByName(more)
    sets = shared.groupBy("members", "mark1", "mark2", F.expr("key & 1L").alias("odd"))
    return sets.agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")).select("key", "members", "weight")


def may_be_shared(segments: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """key, node, need: the keys of `segments` (node, keys by part, need) that fall on a place of a key in `keys`.

    The bitmap has `bits` places whatever the number of keys; it only spares rows that could never join.
    """
    held = keys.select(F.expr(f"key & {bits - 1}L").cast("int").alias("place")).distinct().toArrow()
    places = np.zeros(bits, bool)
    places[held.column("place").to_numpy()] = True
    marks = segments.sparkSession.sparkContext.broadcast(np.packbits(places))

    def pick(batches):
        for batch in batches:
            lists = batch.column("keys")
            own = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            place = own & (bits - 1)
            at = np.flatnonzero((marks.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
            need = batch.column("need").flatten().to_numpy()[2 * row[at] + (own[at] & 1)]
            columns = [pa.array(own[at]), batch.column("node").take(pa.array(row[at])), pa.array(need)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "need"])

    kind = segments.schema["node"].dataType.simpleString()
    return segments.select("node", F.flatten("keys").alias("keys"), "need").mapInArrow(pick, f"key long, node {kind}, need int")


def telling(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """key, node, members: what is left of the groups when every node keeps only its rarest keys.

    A node that shares at least `need` keys of a space with each node it links with needs only so many of its rarest ones that
    `need` - 1 are left out; keys that nobody shares come first. What shares a passage with many documents, but too few
    keys to link with any, leaves all its groups.
    """
    own = Window.partitionBy("node", F.expr("key & 1L"))
    before = F.coalesce(F.sum("weight").over(own.orderBy("members", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = groups.withColumn("before", before).withColumn("shared", F.sum("weight").over(own))
    kept = scratch.stored(ranked.filter("before <= shared - need").select("key", "node"), "rarest")
    left = pinned(kept.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    return kept.join(small_side(left), "key")


def centered(groups: DataFrame) -> DataFrame:
    """key, center, node: the members of each group beside its center; `groups` has key, node, members.

    The center is the node that shares most keys with others, which the original of edited copies does: of the members of the
    group and of the groups that these are in. So the groups of copies that share an edit, which the original is not in,
    have it as their center, too, and a set of copies has few centers however many keys its members share.
    """
    popular = groups.groupBy("node").agg(F.sum("members").alias("shares"))
    within = groups.select("key", "node")
    best = popular.select("node", F.struct("shares", "node").alias("best"))
    for _ in range(HOPS):
        of_keys = within.join(best, "node").groupBy("key").agg(F.max("best").alias("best"))
        best = pinned(within.join(of_keys, "key").groupBy("node").agg(F.max("best").alias("best")))
    of_keys = within.join(best, "node").groupBy("key").agg(F.max("best").alias("best"))
    chosen = pinned(of_keys.select("key", F.col("best.node").alias("center")))
    return within.join(small_side(chosen), "key").filter("node <> center")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """center, node, n (the node's size), m (the center's) and edits (the symmetric difference)."""
    nodes = sets.select("node", F.col("elements").alias("own"))
    centers = sets.select(F.col("node").alias("center"), F.col("elements").alias("its"))
    edits = F.concat(F.array_except("own", "its"), F.array_except("its", "own"))
    both = pairs.join(nodes, "node").join(centers, "center")
    return both.select("center", "node", F.size("own").alias("n"), F.size("its").alias("m"), edits.alias("edits"))


def undecided(stars: DataFrame, known: DataFrame) -> DataFrame:
    """center, node, component: the members of groups that hold, beside the center, members of different components."""
    placed = stars.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    return placed.join(small_side(pinned(split.select("key"))), "key", "left_semi").select("center", "node", "component").distinct()


def in_small_groups(groups: DataFrame) -> DataFrame:
    """u, v: the pairs of groups of at most SMALL members, SMALL - 1 per member at most."""
    few = groups.filter(F.col("members") <= SMALL)
    one, two = few.select("key", F.col("node").alias("u")), few.select("key", F.col("node").alias("v"))
    return one.join(two, "key").filter("u < v").select("u", "v").distinct()


def apart(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Where members of a star that are in different components might link, as they share rare elements of their edits.

    u, v: pairs of members of components one of which is small; center, a, b: pairs of large components.
    Let a(u) be (100 + percent) * |E(u)| - (100 - percent) * |u|. A pair links only if it shares t elements of E with
    2 * (100 + percent) * t >= a(u) + a(v). Members with a(u) <= (100 - percent) * |center| link with the center, so that of two
    members in different components the one with the larger a is beyond that. With elements in one order, the member with the
    smaller a then has a shared element among its first |E(u)| - t + 1 for the least such t, which for members near to the
    center is about half of their edits, and the other among its first D + 1, D being the largest difference that links; behind
    the first element that they share both still have t - 1. Elements that only one component holds join nothing, however
    many of its members hold them, and come first in the order; then the rare ones.
    """
    up, down = 100 + percent, 100 - percent
    most = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * down / up)
    slack = F.size("edits") * F.lit(up).cast("long") - F.col("n") * down
    size = members.groupBy("center", "component").agg(F.count(F.lit(1)).alias("size"))
    sized = members.join(size, ["center", "component"])
    edited = differences(members.select("center", "node"), sets).join(sized, ["center", "node"])
    facts = ["center", "node", "component", "size", most.cast("int").alias("most"), F.size("edits").alias("e"), slack.alias("a")]
    told = scratch.stored(edited.select(*facts, (F.col("m") * F.lit(down).cast("long")).alias("reach"), "edits"), "edits")
    elements = told.select("center", "node", "component", F.explode("edits").alias("element"))
    seen = elements.groupBy("center", "element").agg(
        F.count(F.lit(1)).alias("times"), F.min("component").alias("one"), F.max("component").alias("other")
    )
    shared = elements.select("center", "node", "element").join(seen.filter("one < other").select("center", "element", "times"), ["center", "element"])
    own = Window.partitionBy("center", "node")
    nth = F.col("e") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("times", "element"))
    placed = shared.join(told.drop("edits"), ["center", "node"]).withColumn("nth", nth).filter("nth <= most + 1")
    least = F.ceil((F.col("a") + F.greatest("a", F.col("reach") + 1)) / (2 * up))
    few = F.col("nth") <= F.col("e") - least + 1
    kept = ["center", "element", "node", "component", "size", "a", (F.col("e") - F.col("nth") + 1).alias("rest"), few.alias("few")]
    ordered = scratch.stored(placed.select(*kept), "prefixes")

    def even(a, b):
        return F.col(a) * F.col(b) <= EVEN * (F.col(a) + F.col(b))

    def side(name, rows):
        return rows.select("center", "element", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "component", "size", "a", "rest")])

    first, second = side("u", ordered.filter("few")), side("v", ordered)
    asked = F.struct("a_u", "node_u") < F.struct("a_v", "node_v")
    enough = 2 * up * F.least("rest_u", "rest_v") >= F.col("a_u") + F.col("a_v")
    met = first.join(second, ["center", "element"]).filter((F.col("component_u") != F.col("component_v")) & asked & enough & even("size_u", "size_v"))
    pairs = met.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()

    # Both components of a pair that is not even are larger than EVEN.
    held = ordered.filter(F.col("size") > EVEN).groupBy("center", "element", "component", "size").agg(F.bool_or("few").alias("few"))
    one = held.filter("few").select("center", "element", F.col("component").alias("a"), F.col("size").alias("of_a"))
    other = held.select("center", "element", F.col("component").alias("b"), F.col("size").alias("of_b"))
    large = one.join(other, ["center", "element"]).filter((F.col("a") != F.col("b")) & ~even("of_a", "of_b"))
    return pairs, scratch.stored(large.select("center", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "large")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, n (the size of u) and d (the size of the symmetric difference) of distinct pairs."""
    first = sets.select(F.col("node").alias("u"), F.col("elements").alias("of_u"))
    second = sets.select(F.col("node").alias("v"), F.col("elements").alias("of_v"))
    shared = F.size(F.array_intersect("of_u", "of_v"))
    d = (F.size("of_u") + F.size("of_v") - 2 * shared).cast("long")
    return pairs.join(first, "u").join(second, "v").select("u", "v", F.size("of_u").cast("long").alias("n"), d.alias("d"))


def border(large: DataFrame, members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """center, a, b, side, node, reach, best0, best1: the members of two large components that might link across.

    Let p and q be members of a and b. Then d(u, v) >= (d(u, q) - d(u, p) + d(v, p) - d(v, q)) / 2 for u in a and v in b, by the
    triangle inequality. So the distances of all members to p and q, as many as members, tell which might reach the
    other component: reach is what u adds to the bound on a link, which holds if the sum for u and v is not negative.
    """
    heads = members.groupBy("center", "component").agg(F.min("node").alias("head"))
    two = large.join(heads.select("center", F.col("component").alias("a"), F.col("head").alias("p")), ["center", "a"]).join(
        heads.select("center", F.col("component").alias("b"), F.col("head").alias("q")), ["center", "b"]
    )

    def side(number, component, own, other):
        rows = two.join(members.select("center", F.col("component").alias(component), "node"), ["center", component])
        return rows.select("center", "a", "b", F.lit(number).alias("side"), "node", F.col(own).alias("own"), F.col(other).alias("other"))

    sides = scratch.stored(side(0, "a", "p", "q").unionByName(side(1, "b", "q", "p")), "sides")
    wanted = [sides.select(F.col("node").alias("u"), F.col(c).alias("v")) for c in ("own", "other")]
    known = scratch.stored(distances(wanted[0].unionByName(wanted[1]).distinct(), sets), "distances")
    to_own = known.select(F.col("u").alias("node"), F.col("v").alias("own"), "n", F.col("d").alias("d_own"))
    to_other = known.select(F.col("u").alias("node"), F.col("v").alias("other"), F.col("d").alias("d_other"))
    reach = (100 + percent) * (F.col("d_own") - F.col("d_other")) + 2 * (100 - percent) * F.col("n")
    reached = sides.join(to_own, ["node", "own"]).join(to_other, ["node", "other"]).select("center", "a", "b", "side", "node", reach.alias("reach"))
    reached = scratch.stored(reached, "reach")
    best = reached.groupBy("center", "a", "b").agg(
        *[F.max(F.when(F.col("side") == i, F.struct("reach", "node"))).alias(f"best{i}") for i in (0, 1)]
    )
    opposite = F.when(F.col("side") == 0, F.col("best1.reach")).otherwise(F.col("best0.reach"))
    return scratch.stored(reached.join(best, ["center", "a", "b"]).filter(F.col("reach") + opposite >= 0), "border")


def across(borders: DataFrame, best: bool) -> DataFrame:
    """a, b, u, v: the pairs that might link; with `best` those only of the two members that reach furthest, which are no
    more than members."""
    u = borders.filter("side = 0").select("center", "a", "b", F.col("node").alias("u"), F.col("reach").alias("of_u"), "best0")
    v = borders.filter("side = 1").select("center", "a", "b", F.col("node").alias("v"), F.col("reach").alias("of_v"), "best1")

    def met(u, v):
        return u.join(v, ["center", "a", "b"]).filter("of_u + of_v >= 0").select("a", "b", "u", "v")

    return met(u.filter("u = best0.node"), v).unionByName(met(u, v.filter("v = best1.node"))) if best else met(u, v)


def may_link(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) whose sizes and bit sketches allow a link; `bits` has node, n, bits."""
    first = bits.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
    second = bits.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))
    differ = F.aggregate(F.zip_with("bu", "bv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    sizes = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    allowed = sizes & (differ * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent))
    return pairs.join(first, "u").join(second, "v").filter(allowed).select("u", "v").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) that are similar enough."""
    first = sets.select(F.col("node").alias("u"), F.col("elements").alias("of_u"))
    second = sets.select(F.col("node").alias("v"), F.col("elements").alias("of_v"))
    shared = F.size(F.array_intersect("of_u", "of_v")).cast("long")
    union = F.size("of_u") + F.size("of_v") - shared
    return pairs.join(first, "u").join(second, "v").filter(100 * shared >= percent * union).select("u", "v").distinct()


def class_links(segments: DataFrame, docs: DataFrame, settings: JaccardSettings, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """node, component: what links between classes reach; `segments` has node, n, keys, need, bits of each class."""
    percent = settings.percent
    kept = scratch.stored(one_key_per_set(segments, scratch), "sets-of-nodes")
    groups = scratch.stored(telling(may_be_shared(segments, kept, settings.bits).join(kept, "key"), scratch), "groups")
    release(docs.sparkSession)
    # Of most candidates the bit sketches say that they cannot link; only the others' shingles are fetched.
    held = pinned(groups.select("node").distinct())
    shown = scratch.stored(segments.select("node", "n", "bits").join(small_side(held), "node", "left_semi"), "bits")
    crowds = groups.filter(F.col("members") > SMALL)
    stars = scratch.stored(centered(crowds), "stars")
    ordered = stars.select(F.least("center", "node").alias("u"), F.greatest("center", "node").alias("v"))
    candidates = in_small_groups(groups).unionByName(ordered.distinct()).distinct()
    near = scratch.stored(may_link(candidates, shown, percent), "near")
    ends = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node")))
    needed = pinned(ends.unionByName(crowds.select("node")).distinct())
    sets = scratch.stored(shingle_sets(docs, needed, settings, doc_id, text), "shingles")

    links = pinned(verified(near, sets, percent))
    found = components(links)
    members = scratch.stored(undecided(stars, found), "undecided")
    if members.isEmpty():
        return found
    pairs, large = apart(members, sets, percent, scratch)
    more = pinned(verified(may_link(pairs, shown, percent), sets, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = None
    if large.isEmpty():
        return components(links) if found is None else found
    borders = border(large, members, sets, percent, scratch)
    furthest = across(borders, best=True).select("u", "v").distinct()
    links = pinned(links.unionByName(verified(may_link(furthest, shown, percent), sets, percent)))
    found = components(links)
    names = [found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
    still = borders.join(names[0], "a", "left").join(names[1], "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    rest = across(still, best=False).select("u", "v").distinct()
    last = pinned(verified(may_link(rest, shown, percent), sets, percent))
    return found if last.isEmpty() else components(links.unionByName(last))


def linked(
    docs: DataFrame, settings: JaccardSettings | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links); one row per document."""
    settings = settings or JaccardSettings()
    docs, row = told_apart(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stored(sketched(docs, settings, row, "text").withColumnRenamed("doc_id", "row"), "sketches")
    equal = ["s1", "s2", "n_shingles"]
    full = rows.filter("n_shingles > 0")
    classes = pinned(full.groupBy(*equal).agg(F.min("row").alias("node")))
    copies = pinned(full.select("row").join(classes.select(F.col("node").alias("row")), "row", "left_anti"))
    of_classes = full.filter("size(flatten(keys)) > 0").join(small_side(copies), "row", "left_anti")
    segments = of_classes.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "keys", "need", "bits")
    found = class_links(segments, docs, settings, row, "text", scratch)

    named = classes.join(found, "node", "left").select(*equal, F.coalesce("component", "node").alias("component"))
    placed = pinned(rows.select("row", *equal).join(named, equal, "left").select("row", "n_shingles", "component"))
    scratch.clear()  # what is needed of them is checkpointed
    if row == "doc_id":
        return placed.select(F.col("row").alias("doc_id"), "n_shingles", F.coalesce("component", "row").alias("component_id"))
    # Rows that share an id are one document, so that their components are one; then components take their smallest id.
    ids = placed.join(docs.select(F.col(row).alias("row"), "doc_id"), "row")
    least = ids.filter("component is not null and doc_id is not null").groupBy("doc_id", "component").count()
    first = least.groupBy("doc_id").agg(F.min("component").alias("v"))
    joined = components(least.join(first, "doc_id").select(F.col("component").alias("u"), "v"))
    whole = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    ids = ids.join(whole, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
    smallest = ids.filter("whole is not null").groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    known = ids.join(smallest, "whole", "left")
    return known.select("doc_id", "n_shingles", F.when(F.col("whole").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
