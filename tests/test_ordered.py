"""Running values: the blocked way gives what a plain window gives, whatever the keys look like."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from modelyard.operators import ordered, splits
from modelyard.operators.lifecycle import STATES, MOVES, follow_moves, transition_audit
from modelyard.operators.metrics import running_best
from modelyard.operators.ordered import Running, running
from modelyard.operators.splits import ordered_batches, shuffled_batches

def steps():
    return [
        Running("n", "count"),
        Running("n_before", "count", before=True),
        Running("total", "sum", F.col("v")),
        Running("best", "max", F.col("v")),
        Running("best_before", "max", F.col("v"), before=True),
        Running("least", "min", F.col("v")),
        Running("known", "last", F.col("v")),
        Running("known_before", "last", F.col("v"), before=True),
        Running("prior", "previous", F.col("v")),
    ]


def rows(seed: int, n: int = 600):
    draw = random.Random(seed)
    keys = ["hot"] * 4 + [None, "a", "b", "c"] + [f"k{i}" for i in range(20)]
    return [
        (draw.choice(keys), i, draw.choice([None, draw.randint(-50, 50)]), draw.choice(STATES)) for i in range(n)
    ]


@pytest.fixture(scope="module", params=[1, 2])
def table(spark, request):
    return spark.createDataFrame(rows(request.param), "k string, i bigint, v bigint, s string").repartition(5)


def as_set(df):
    return sorted(map(repr, df.collect()))


def test_blocked_equals_plain(table):
    plain = running(table, ["k"], ["i"], steps(), max_rows_per_key=10_000)
    blocked = running(table, ["k"], ["i"], steps(), max_rows_per_key=7)
    assert plain.columns == blocked.columns
    assert as_set(plain) == as_set(blocked)


def test_blocked_against_brute_force(table):
    got = {(r["k"], r["i"]): r for r in running(table, ["k"], ["i"], steps(), max_rows_per_key=7).collect()}
    by_key = {}
    for r in sorted(table.collect(), key=lambda r: r["i"]):
        by_key.setdefault(r["k"], []).append(r)
    for key, members in by_key.items():
        for at, r in enumerate(members):
            seen = [m["v"] for m in members[: at + 1] if m["v"] is not None]
            before = [m["v"] for m in members[:at] if m["v"] is not None]
            row = got[(key, r["i"])]
            assert (row["n"], row["n_before"]) == (at + 1, at)
            assert row["total"] == (sum(seen) if seen else None)
            assert row["best"] == max(seen, default=None)
            assert row["best_before"] == max(before, default=None)
            assert row["least"] == min(seen, default=None)
            assert row["known"] == (seen[-1] if seen else None)
            assert row["known_before"] == (before[-1] if before else None)
            assert row["prior"] == (members[at - 1]["v"] if at else None)


def test_groups_of_blocks_equal_plain(table, monkeypatch):
    """Hundreds of tiny blocks, summed up three by three, their carries joined by a shuffle."""
    monkeypatch.setattr(ordered, "GROUP", 3)
    monkeypatch.setattr(ordered, "MOST_BROADCAST", 2)
    plain = running(table, ["k"], ["i"], steps(), max_rows_per_key=10_000)
    assert as_set(plain) == as_set(running(table, ["k"], ["i"], steps(), max_rows_per_key=2))
    counted = running(table, [], ["i"], [Running("n", "count"), Running("prior", "previous", F.col("i"))], max_rows_per_key=2).collect()
    assert all(r["n"] == r["i"] + 1 and r["prior"] == (r["i"] - 1 if r["i"] else None) for r in counted)


def test_offsets_of_more_than_65536_blocks(spark, table, monkeypatch):
    """Blocks of five digits, one row in most, summed up two and one digits at a time."""
    names = [f"{i * 9973 % 16**5:05x}" for i in range(70_000)]
    counts = spark.createDataFrame([(name, 1 + i % 3) for i, name in enumerate(names)], "_block string, _n long")
    want, total = {}, 0
    sizes = {name: 1 + i % 3 for i, name in enumerate(names)}
    for name in sorted(names):
        want[name] = total
        total += sizes[name]
    assert len(want) == 70_000
    for digits in (3, 2, 1):
        monkeypatch.setattr(splits, "DIGITS_AT_ONCE", digits)
        assert {r["_block"]: r["_offset"] for r in splits.block_offsets(counts, 5).collect()} == want
    one = {r["i"]: r["position"] for r in shuffled_batches(table, "i", epoch=1).collect()}
    monkeypatch.setattr(splits, "ROWS_PER_BLOCK", 0.0005)  # a million blocks for six hundred rows
    assert one == {r["i"]: r["position"] for r in shuffled_batches(table, "i", epoch=1).collect()}


def test_without_keys(table):
    got = running(table, [], ["i"], [Running("n", "count")], max_rows_per_key=50).collect()
    assert all(r["n"] == r["i"] + 1 for r in got)


def test_running_best_is_strict(spark):
    df = spark.createDataFrame(
        [("r", 1, 0.0), ("r", 2, 0.5), ("r", 3, 0.5), ("r", 4, 0.4), ("r", 5, 0.6), ("zero", 1, 0.0)],
        "run string, epoch int, acc double",
    )
    for cap in (100, 2):
        got = {(r["run"], r["epoch"]): (r["best"], r["is_best"]) for r in running_best(df, ["run"], ["epoch"], "acc", cap).collect()}
        assert got == {
            ("r", 1): (0.0, False), ("r", 2): (0.5, True), ("r", 3): (0.5, False), ("r", 4): (0.5, False),
            ("r", 5): (0.6, True), ("zero", 1): (0.0, False),
        }


def test_moves_blocked_equal_plain_and_brute_force(table):
    known = table.filter("k is not null")
    plain = follow_moves(known, "k", ["i"], "s", max_rows_per_key=10_000)
    blocked = follow_moves(known, "k", ["i"], "s", max_rows_per_key=9)
    assert as_set(plain.select(sorted(plain.columns))) == as_set(blocked.select(sorted(blocked.columns)))
    at = {}
    for r in sorted(plain.collect(), key=lambda r: r["i"]):
        state = at.get(r["k"], "INIT")
        ok = (state, r["s"]) in MOVES
        at[r["k"]] = r["s"] if ok else state
        assert (r["accepted"], r["state_after"]) == (ok, at[r["k"]])


def test_audit_blocked_equals_plain(table):
    known = table.filter("k is not null")
    plain = transition_audit(known, "k", ["i"], "s", max_rows_per_key=10_000)
    assert as_set(plain) == as_set(transition_audit(known, "k", ["i"], "s", max_rows_per_key=9))
    assert plain.count() > 0


def test_shuffle_is_a_permutation_that_changes_with_the_epoch(table):
    one = {r["i"]: r["position"] for r in shuffled_batches(table, "i", epoch=1).collect()}
    two = {r["i"]: r["position"] for r in shuffled_batches(table, "i", epoch=2).collect()}
    assert sorted(one.values()) == list(range(600)) == sorted(two.values())
    assert one != two
    again = {r["i"]: r["position"] for r in shuffled_batches(table.repartition(11), "i", epoch=1).collect()}
    assert one == again


def test_shuffle_with_many_blocks(table, monkeypatch):
    from modelyard.operators import splits

    one = {r["i"]: r["batch"] for r in shuffled_batches(table, "i", epoch=1).collect()}
    monkeypatch.setattr(splits, "ROWS_PER_BLOCK", 3)
    assert one == {r["i"]: r["batch"] for r in shuffled_batches(table, "i", epoch=1).collect()}


def test_batches_in_order(table):
    got = ordered_batches(table, "i").collect()
    assert all(r["batch"] == r["i"] // 64 for r in got)
    assert sum(r["batch"] == 9 for r in got) == 600 - 9 * 64
