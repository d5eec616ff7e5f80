"""Mixing: targets and taken words against plain loops, permutations, layouts."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from modelyard.llm import mixing
from modelyard.llm.mixing import MixSettings


def targets(sizes: dict) -> dict:
    """Shares by weight, capped at three sizes, the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("settings", [MixSettings(), MixSettings(block=7, shard=16), MixSettings(block=64, shard=5)])
def test_hard_rows(hard, hard_rows, settings):
    found = mixing.mix(hard, settings).taken().collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, size(t)) for i, t, *_ in hard_rows)
    sizes = Counter()
    for _, text, _, source, _ in hard_rows:
        sizes[source] += size(text)
    want = sorted((sizes[s], t) for s, t in targets(sizes).items())
    taken, told = Counter(), {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
        told[(r["source_size"], round(r["target"], 6))] = r["target"]
    assert sorted(told) == sorted({(n, round(t, 6)) for n, t in want})
    for key, target in told.items():
        assert sum(int(t) for n, t in want if (n, round(t, 6)) == key) == taken[key]


def test_taken_is_what_the_slots_say(documents):
    """Every slot's words, walked one by one over the source's line, against the joined result."""
    settings = MixSettings(block=50, shard=64)
    mix = mixing.mix(documents, settings)
    slots = mix.slots.collect()
    pieces = mix.pieces.collect()
    words = Counter()
    for slot in slots:
        for at in range(slot["words"]):
            words[(slot["sid"], slot["block"], at)] += 1
    want = Counter()
    for p in pieces:
        if p["block"] is not None:
            want[p["doc_id"]] += sum(words[(p["sid"], p["block"], at)] for at in range(p["from"], p["until"]))
    got = {r["doc_id"]: r["taken"] for r in mix.taken().collect()}
    assert got == {i: want[i] for i in got}
    shards = Counter(s["shard"] for s in slots)
    assert all(n == 64 for k, n in shards.items() if k < max(shards)) and shards[max(shards)] <= 64
    # Within a pass every block comes once.
    quota = {q["sid"]: q for q in mix.sources.collect()}
    passes = Counter((s["sid"], s["slot"] // quota[s["sid"]]["blocks"], s["block"]) for s in slots)
    assert set(passes.values()) == {1}


def test_layout_does_not_matter(documents):
    settings = MixSettings(block=50, shard=64)
    one = sorted(map(tuple, mixing.mix(documents, settings).taken().collect()))
    assert one == sorted(map(tuple, mixing.mix(documents.repartition(5, "text"), settings).taken().collect()))
    other = sorted(map(tuple, mixing.mix(documents, replace(settings, seed=8)).taken().collect()))
    assert one != other


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
    found = [r["p"] for r in rows.collect()]
    assert sorted(found) == list(range(n)) and (n < 10 or found != sorted(found))


def test_empty(empty, spark):
    assert mixing.mix(empty).taken().count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix(blank).taken().collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
