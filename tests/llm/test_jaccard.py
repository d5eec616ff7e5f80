"""The similarity join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from modelyard.llm import jaccard
from modelyard.llm.components import components
from modelyard.llm.jaccard import Bands, JaccardSettings


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    """id -> (number of shingles of each row with it, component), over all pairs of rows; rows that share an id are linked."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            shared = len(x & y)
            alike = bool(x) and bool(y) and 100 * shared >= percent * (len(x) + len(y) - shared)
            if alike or (i is not None and i == j and x and y):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return sorted(((i, len(x), least.get(root(n))) for n, (i, x) in enumerate(sets)), key=repr)


def linked(docs, settings):
    return sorted(map(tuple, jaccard.linked(docs, settings).collect()), key=repr)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_hard_rows(hard, hard_rows, size, percent):
    assert linked(hard, JaccardSettings(size, percent)) == brute([r[:2] for r in hard_rows], size, percent)


@pytest.mark.parametrize("seed,size,percent,small", [(1, 3, 90, 1), (2, 5, 80, 16), (3, 1, 60, 16)])
def test_chains_of_edits(spark, seed, size, percent, small, monkeypatch):
    """Long chains of small edits, copies, and pairs just above and below the threshold."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng, rows = random.Random(seed), []
    for family in range(12):
        text = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([2, 9, 11, 25, 60, 200]))]
        for _ in range(20):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = f"w{rng.randint(0, 5000)}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert linked(docs, JaccardSettings(size, percent)) == brute(rows, size, percent)


def test_rows_without_ids_link(spark):
    """a and c link only through b, whose row has no id; the first two without ids that reach no other have no component."""
    a, rng = [f"w{i}" for i in range(100)], random.Random(1)
    b, c = a[:96] + ["x"] * 4, a[4:96] + ["x"] * 4
    alone = [f"v{i}" for i in range(30)]
    rows = [(1, a), (None, b), (2, c), (None, alone), (None, alone[:29] + ["z"]), (5, [f"u{i}" for i in range(30)]), (None, None), (None, "")]
    rows = [(i, " ".join(text) if text else text) for i, text in rows]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = linked(docs, JaccardSettings(3, 80))
    assert found == brute(rows, 3, 80)
    assert [f for f in found if f[2] == 1 and f[1] > 90] and len({f[2] for f in found if f[1] > 90}) == 1


def test_repeated_ids_are_one_document(spark):
    rows = [(4, "a b c d e f"), (2, "g h i j k l"), (4, "m n o p q r"), (1, "m n o p q r"), (2, "a b c d e f"), (8, ""), (8, "x y z x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(docs, JaccardSettings(3, 90)) == brute(rows, 3, 90)
    rows = [(7, "a b c d e f"), (7, "q r s t u v"), (3, "q r s t u v"), (9, "a b c d e f"), (1, "x"), (1, None), (None, "x"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(docs, JaccardSettings(3, 90)) == brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_every_similar_pair_shares_a_key(percent):
    """Pairs at the largest difference that still links, for sets of all sizes."""
    rng, bands = np.random.default_rng(percent), Bands(percent)
    for size in [*range(1, 60), 100, 333, 1000]:
        for larger in {size, size + 1, 100 * size // percent}:
            shared = -(-percent * (size + larger) // (100 + percent))
            if larger < size or shared > size or (shared == size == larger):
                continue
            for _ in range(20):
                both = rng.integers(0, 1 << 64, shared + (size - shared) + (larger - shared), dtype=np.uint64)
                a, b = both[:size], np.concatenate([both[:shared], both[size:]])
                keys = [
                    set(np.concatenate([jaccard.sketch(np.sort(x), *s) for s in bands.of(len(x))]).tolist()) for x in (a, b)
                ]
                assert keys[0] & keys[1], (size, larger, shared)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1300)]
    edges += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)] + [(5, 5)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert {r["node"]: r["component"] for r in found} == {i: root(i) for i in parent} and len(found) == len(parent)


def test_empty(empty):
    assert jaccard.linked(empty).count() == 0


@pytest.mark.parametrize("percent,size,edits,small", [(90, 3, (1, 4), 1), (80, 5, (2, 6), 1), (80, 5, (2, 6), 16), (90, 1, (4, 16), 1), (90, 1, (4, 16), 4)])
def test_copies_that_mostly_do_not_link(spark, percent, size, edits, small, monkeypatch):
    """Copies edited about as much as links allow: some link with the original, some only with copies of their own."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(percent + size)
    base = [f"w{rng.randint(0, 9000)}" for _ in range(150)]
    rows = []

    def copy(text, n):
        text = list(text)
        for _ in range(n):
            kind, at = rng.choice("ride"), rng.randrange(len(text))
            if kind == "d":
                del text[at]
            elif kind == "i":
                text.insert(at, f"n{rng.randint(0, 9000)}")
            else:
                text[at] = f"n{rng.randint(0, 9000)}"
        rows.append((len(rows), " ".join(text)))
        return text

    for _ in range(90):
        first = copy(base, rng.randint(*edits))
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy(first, rng.randint(1, edits[0]))
    if percent == 90:
        rows.append((len(rows), " ".join(base)))
    rng.shuffle(rows)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, size, percent)
    assert linked(docs, JaccardSettings(size, percent)) == want
    assert 10 < len({c for _, _, c in want}) < len(rows)


@pytest.mark.parametrize("editions,copies,share", [(2, 500, 0.75), (3, 60, 0.75), (2, 60, 0.795)])
def test_editions_are_not_compared_copy_by_copy(spark, editions, copies, share, monkeypatch):
    """Two large groups of near copies that share keys but do not link: as many pairs as members, not all across."""
    rng, rows, counted = random.Random(copies), [], []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    for edition in range(editions):
        text = list(base)
        for at in range(int(len(text) * share), len(text)):  # one run of other words at the end
            text[at] = f"e{edition}-{at}" if edition else text[at]
        for _ in range(copies):
            copy = list(text)
            for at in rng.sample(range(200), 4):
                copy[at] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    for name in ("may_link", "distances"):
        plain = getattr(jaccard, name)

        def counting(pairs, *more, plain=plain):
            counted.append(pairs.count())
            return plain(pairs, *more)

        monkeypatch.setattr(jaccard, name, counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = linked(docs, JaccardSettings(1, 80))
    if copies < 100:
        assert found == brute(rows, 1, 80)
    else:
        assert len({c for _, _, c in found}) == 2
    # One center per group of keys, and the members of the largest groups are each compared with few centers.
    assert sum(counted) < 40 * len(rows), counted


def test_far_copies_are_not_paired(spark, monkeypatch):
    """Many copies of one text, edited more than links with it allow, at places that are the same by chance: few pairs are compared."""
    rng, rows, counted = random.Random(8), [], []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(180)]
    for _ in range(400):
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.randint(2, 7)):
            copy[at] = f"n{rng.randint(0, 10**6)}"
        rows.append((len(rows), " ".join(copy)))
    plain = jaccard.may_link

    def counting(pairs, *more):
        counted.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(jaccard, "may_link", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = linked(docs, JaccardSettings(5, 80))
    assert found == brute(rows, 5, 80)
    assert 100 < len({c for _, _, c in found}) < len(rows)
    # Behind the pairs within small groups and with the centers come those that share rare edits.
    assert len(counted) > 1 and sum(counted[1:]) < 5 * len(rows), counted


def test_a_link_at_the_border_of_two_groups(spark):
    """Large groups that do not link with each other's centers, but two of their members do."""
    rng, rows = random.Random(7), []
    base = [f"w{i}" for i in range(300)]
    other = [f"o{i}" if i >= 262 else w for i, w in enumerate(base)]
    for text in (base, other):
        for _ in range(40):
            copy = list(text)
            for at in rng.sample(range(200), 5):
                copy[at] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    bridge = base[:281] + [f"o{i}" for i in range(281, 300)]
    rows.append((len(rows), " ".join(bridge)))
    want = brute(rows, 1, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert linked(docs, JaccardSettings(1, 85)) == want
    assert linked(docs.filter("doc_id < 80"), JaccardSettings(1, 85)) == brute(rows[:80], 1, 85)
    assert len({c for _, _, c in want}) < len({c for _, _, c in brute(rows[:80], 1, 85)})


def test_border_bound_holds(spark, tmp_path):
    """No pair that links across two groups is left out by the distances to their heads."""
    from modelyard.session import Scratch

    rng = random.Random(2)
    sets, members = [], []
    for node in range(60):
        base = set(range(0, 100)) if node < 30 else set(range(12, 112))
        for _ in range(rng.randint(0, 12)):
            base.discard(rng.randrange(112))
            base.add(rng.randrange(140))
        sets.append((node, sorted(base)))
        members.append((0, node, 0 if node < 30 else 30))
    tables = spark.createDataFrame(sets, "node long, elements array<long>"), spark.createDataFrame(members, "center long, node long, component long")
    large = spark.createDataFrame([(0, 0, 30)], "center long, a long, b long")
    for percent in (70, 80, 85, 90):
        near = jaccard.border(large, tables[1], tables[0], percent, Scratch(spark))
        got = {(r["u"], r["v"]) for r in jaccard.across(near, best=False).collect()}
        first = {(r["u"], r["v"]) for r in jaccard.across(near, best=True).collect()}
        want = set()
        for u, x in sets[:30]:
            for v, y in sets[30:]:
                shared = len({*x} & {*y})
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    want.add((u, v))
        assert want <= got and first <= got and len(first) <= 60
    assert len(got) < 900
