"""Word hashes against regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modelyard.llm.bytewords import WordHasher, between_spaces, letters_and_digits, shingled

KINDS = [(between_spaces, r"[^\x20\x09-\x0D]+"), (letters_and_digits, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("table,pattern", KINDS)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 \t\n\x0b.~éß語\x7f\x00", max_size=40)), max_size=8), st.integers(1, 60))
def test_same_words_same_hashes(table, pattern, texts, limit):
    found = list(WordHasher(table(), limit).rows(pa.array(texts, pa.string())))
    names = {}
    for text, hashes in zip(texts, found, strict=True):
        words = re.findall(pattern, lowered(text))
        assert len(words) == len(hashes)
        for word, value in zip(words, hashes.tolist(), strict=True):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_slices_and_prefixes():
    column = pa.array(["xx", "abcdef abc", None, "abcxyz"]).slice(1, 3)
    runs = list(WordHasher(letters_and_digits(), prefixes=(3,)).runs(column))
    (_, words, bounds), = runs
    assert bounds.tolist() == [0, 2, 2, 3]
    assert words[1, 0] == words[1, 1] == words[1, 2] and len(set(words[0].tolist())) == 3


def test_shingles():
    words = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    found = shingled(words, 3)
    assert len(found) == 4 and found[0] == found[3] and len(set(found.tolist())) == 3
    assert len(shingled(words[:2], 3)) == 1 and len(shingled(words[:0], 3)) == 0
