"""Column functions against Python's own on generated texts."""

from __future__ import annotations

from pathlib import PurePosixPath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelyard.functions import text

slow = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)
words = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30)
spaced = st.text(st.sampled_from("ab \t\n\r\x0b\x1c\x85\xa0 　é"), max_size=12)
name = st.text(st.sampled_from("aB.é_"), min_size=1, max_size=8).filter(lambda n: n.strip("."))
paths = st.lists(name, min_size=1, max_size=4).map("/".join)


def apply(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["v"] for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


@slow
@given(values=st.lists(st.one_of(words, spaced), min_size=50, max_size=80))
def test_strip_and_counts(spark, values):
    assert apply(spark, values, text.strip) == [v.strip() for v in values]
    assert apply(spark, values, text.line_count) == [v.count("\n") + 1 for v in values]


@slow
@given(values=st.lists(paths, min_size=50, max_size=80))
def test_paths(spark, values):
    assert apply(spark, values, text.file_extension) == [PurePosixPath(v).suffix.lower() for v in values]
    assert apply(spark, values, text.parent_dir) == [str(PurePosixPath(v).parent) for v in values]


@slow
@given(values=st.lists(words, min_size=50, max_size=80), language=st.sampled_from(["", "python", "json"]))
def test_fenced_text_comes_back(spark, values, language):
    bodies = [v.replace("`", "") for v in values]
    assert apply(spark, [f"```{language}\n{b}\n```" for b in bodies], text.strip_fences) == bodies


@slow
@given(keys=st.lists(st.text(st.sampled_from("aZ09-_ "), max_size=45), min_size=50, max_size=80))
def test_masks_never_show_a_whole_key(spark, keys):
    for key, shown in zip(keys, apply(spark, keys, text.mask)):
        assert len(shown.replace(".", "")) <= 4
        assert not key or shown != key
