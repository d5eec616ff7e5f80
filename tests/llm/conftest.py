"""Hard rows for every operator: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "score double, lang_pred string, size long, key long, node long, words string, label int, items string, n long, "
CLASHING += "_quality string, quality string, _language string, language string, share double, _row string, row string, _gone int, gone int, "
CLASHING += "member long, component_id long, place string, first string, id string, times long, component string"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def hard_rows():
    rng = random.Random(4)
    body = sentence(rng, 60)
    words = body.split()
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one", "en", "b", 3),
        (5, "ONE", None, "b", 3),
        (6, body, "fr", "c", 1),
        (6, body, "fr", "c", 1),
        (7, body.upper().replace("É", "é"), "fr", None, 1),
        (8, " ".join([*words[:-1], "other"]), "fr", "c", 1),
        (9, " ".join([*words[:20], "x y z", *words[20:]]), "fr", "", 1),
        (10, sentence(rng, 20_000), "de", "c", 1),
        (11, "word" * 200_000, "de", "d", 1),
        (12, "12 34 !! 56", "es", "d", 1),
        (None, body, "fr", "c", 1),
        (None, "nobody", None, None, None),
        (13, "日本 語   x", "ja", "é", 1),
    ]
    rows += [(100 + i, sentence(rng, rng.randint(1, 80)), rng.choice(["en", "de"]), rng.choice("abc"), 1) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The rows with columns that operators use as names of their own."""
    plain = spark.createDataFrame(hard_rows, SCHEMA)
    extra = [f"cast(null as {kind}) as {name}" for name, kind in (c.split() for c in CLASHING.split(", "))]
    return plain.selectExpr("*", *extra).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
