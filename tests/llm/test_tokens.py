"""Token counts against the library, text by text."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from modelyard.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    "a <|endoftext|> b<|startoftext|>x", "é ́a ΑΣ Σ\x1c!\x1c! x\x85y z", "it's DON'T 123 4\x005", " ab" * 600_000,
    "x" * 30_000, "﻿​ İ ß ǅ", "<|endoftext|>" * 3, "a\x0bb\x0cc\rd",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("frequent", [0, 50, 50_000])
def test_tricky_texts(spark, library, frequent):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for row in tokens.token_counts(docs, PATH, 100, frequent=frequent).collect():
        n = library(TRICKY[row["doc_id"]])
        assert (row["n_tokens"], row["over_limit"], row["n_bytes"]) == (n, n > 100, len(TRICKY[row["doc_id"]].encode()))


def test_small_cache(spark, library, documents, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    want = sorted((r["doc_id"], library(r["text"])) for r in documents.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(documents, PATH, 2048, frequent=5).collect()) == want


def test_hard_rows(hard, hard_rows, library):
    want = sorted(((i, len((t or "").encode()), library(t)) for i, t, *_ in hard_rows), key=repr)
    found = tokens.token_counts(hard, PATH, 2048).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found), key=repr) == want


def test_empty(empty):
    assert tokens.token_counts(empty, PATH, 5).count() == 0


@pytest.mark.parametrize("piece", [1 << 20, 7, 30])
def test_pre_tokens_and_their_hashes(piece, monkeypatch):
    """The runs of bytes that split() gives, in texts cut into pieces or not, one hash for one word, case kept."""
    monkeypatch.setattr(tokens, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice(["a", "A", "é", "  ", "\n", "\t", "\x0b", "日", "xxxxx", " "]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [None, "", " " * 50, "y" * 90]
    hasher = tokens.PreTokens()
    hasher.limit = piece
    found, named = [[] for _ in texts], {}
    for first, data, hashes, bounds, opens, closes in hasher.found(pa.array(["skipped", *texts]).slice(1)):
        words = tokens._words(data, opens, closes)
        for i in range(len(bounds) - 1):
            found[first + i] += words[bounds[i] : bounds[i + 1]]
        for word, own in zip(words, hashes.tolist(), strict=True):
            assert named.setdefault(word, own) == own
    assert found == [(t or "").encode().split() for t in texts]
    assert len(set(named.values())) == len(named)


def test_unsafe_tokenizers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 5)


def test_frequent_pre_tokens(spark, monkeypatch):
    """The most frequent ones with their ties by name, also when tasks forget rare ones on the way."""
    words = [f"w{i}" for i in range(300) for _ in range(1 + (i < 40) * (60 - i))]
    random.Random(2).shuffle(words)
    docs = spark.createDataFrame([(" ".join(words[i : i + 50]),) for i in range(0, len(words), 50)] + [(None,)], "text string").repartition(3)
    assert tokens.frequent_pre_tokens(docs, "text", 40) == [f"w{i}".encode() for i in range(40)]
    monkeypatch.setattr(tokens, "CACHED", 50)
    assert tokens.frequent_pre_tokens(docs, "text", 10) == [f"w{i}".encode() for i in range(10)]
