"""Chat formatting: exact round trips, the state machine, hard rows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from modelyard.llm import chat

TRICKY = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s>", "<s", "[/INST", "", "a\\", " [/ROLE]", "[TEXT] x", "<</s>>", "é\n[SYS]"]


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(TRICKY)] + [(i, 1, "assistant", t) for i, t in enumerate(TRICKY)]
    rows += [
        (50, 0, "assistant", "first"),
        (51, 0, "user", None),
        (51, 1, None, "no role"),
        (51, 2, "tool [/ROLE]", "named </s>"),
        (52, 0, "system", "s"), (52, 1, "user", "u"), (52, 2, "assistant", "a"), (52, 3, "user", "u"), (52, 4, "assistant", "b"),
        (None, 0, "user", "nobody"),
        (53, None, "user", "null turn"), (53, 0, "assistant", "x"),
        (54, 0, "user", "same"), (54, 0, "user", "same"),
    ]
    rows += [(60, i, "user" if i % 2 == 0 else "assistant", f"t{i} " * 50) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'x' as formatted", "1 as segments", "2 as state", "3 as rows"
    ).repartition(4)


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {conv: sorted(turns) for conv, turns in by.items()}


def test_round_trip(chats):
    rows, table = chats
    formatted = chat.formatted(table)
    read = {r["conv_id"]: r["turns"] for r in formatted.select("conv_id", chat.parsed(formatted["formatted"]).alias("turns")).collect()}
    want = expected(rows)
    assert set(read) == set(want)
    for conv, turns in want.items():
        assert [(t["role"], t["text"], t["loss"]) for t in read[conv]] == [(r, t, r == "assistant") for _, r, t in turns]


def test_digests(chats):
    rows, table = chats
    for row in chat.digests(chat.formatted(table)).collect():
        turns = expected(rows)[row["conv_id"]]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_states(chats):
    state = {r["conv_id"]: (r["state"], r["valid"]) for r in chat.formatted(chats[1]).collect()}
    assert state[0] == state[52] == state[60] == ("assistant", True)
    assert state[50] == state[51] == state[54] == ("invalid", False)
    assert state[None] == ("user", False)


def test_loss_flags_hold_texts_only(chats):
    """Three segments a turn; what is under the flags, unescaped, is the assistant's texts and nothing between."""
    template, made = chat.ChatTemplate(), chat.formatted(chats[1])
    rows = made.select("segments", chat.parsed(F.col("formatted")).alias("turns")).collect()
    plain = made.select(F.explode("segments").alias("s")).select("s.loss", chat.unescaped(F.col("s.text"), template).alias("text"))
    for row in rows:
        assert len(row["segments"]) == 3 * len(row["turns"])
        for i, turn in enumerate(row["turns"]):
            opens, text, closes = row["segments"][3 * i : 3 * i + 3]
            assert not opens["loss"] and not closes["loss"] and text["loss"] == (turn["role"] == "assistant")
    texts = sorted(t["text"] for row in rows for t in row["turns"] if t["role"] == "assistant")
    assert sorted(r["text"] for r in plain.filter("loss").collect()) == texts
    assert chat.digests(made).filter("not loss_agrees").count() == 0


def test_segments_are_the_text(chats):
    for row in chat.formatted(chats[1]).collect():
        assert row["formatted"] == "<s>" + "".join(s["text"] for s in row["segments"])


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(none)).count() == 0
