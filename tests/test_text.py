"""Text functions on small hand tables and on rendered texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelyard.functions import text
from modelyard.operators.answers import answers_to_spec
from modelyard.operators.documents import assembled_context, descriptions, fenced_blocks, split_files


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r["v"] for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "path,ext,parent",
    [
        ("a/b/c.TXT", ".txt", "a/b"),
        ("c.tar.gz", ".gz", "."),
        ("a/.hidden", "", "a"),
        (".hidden.py", ".py", "."),
        ("a.b/c", "", "a.b"),
        ("a/c.", "", "a"),
        ("name", "", "."),
    ],
)
def test_paths(spark, path, ext, parent):
    assert values(spark, [path], text.file_extension) == [ext]
    assert values(spark, [path], text.parent_dir) == [parent]


def test_below(spark):
    assert values(spark, ["file:/data/x/a/b.txt", "s3a://bucket/x", "/data/x/c"], lambda c: text.below(c, "/data/x/")) == [
        "a/b.txt", "/bucket/x", "c",
    ]


def test_strip_fences(spark):
    texts = ["```python\nx = 1\n```", "x = 1", "```", "```\n```", "a\n```", "  ```py\nb", "```\nc\n  ``` ", "d\n```py"]
    assert values(spark, texts, text.strip_fences) == ["x = 1", "x = 1", "", "", "a", "b", "c", "d\n```py"]


def files(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    found = split_files(df, "raw", []).collect()
    return {r["name"]: r["content"] for r in found}, {r["summary"] for r in found}


def test_sections(spark):
    raw = (
        "Here you go\n=== FILE: model.py ===\n```python\nimport x\n\ny = 1\n```\n\n===FILE:  data.py  ===\n z \n"
        "=== FILE: empty.txt ===\n\n=== FILE: noextension ===\nlost\n=== SUMMARY ===\n Short. \n"
    )
    assert files(spark, raw) == ({"model.py": "import x\n\ny = 1", "data.py": "z"}, {"Short."})


def test_section_preamble_with_a_dot_does_not_swallow_a_file(spark):
    assert files(spark, "Done.\n=== FILE: a.py ===\n1")[0] == {"a.py": "1"}


def test_section_names(spark):
    long = "n" * 48 + ".py"
    assert files(spark, f"=== FILE: {long} ===\n1\n=== FILE: ok.py ===\n2\n=== FILE: ok.py ===\n3")[0] == {"ok.py": "3"}


def test_default_summary_and_last_summary(spark):
    assert files(spark, "=== FILE: a.py ===\n1")[1] == {text.DEFAULT_SUMMARY}
    assert files(spark, "=== SUMMARY ===\none\n=== FILE: a.py ===\n1\n=== SUMMARY ===\ntwo")[1] == {"two"}


def test_fenced_fallback(spark):
    raw = "### model.py\n```python\nx = 1\n```\nthen\nconfig.yaml \n\n```\na: 1\n\n```\n#### model.py\n```\nx = 2\n```\nbare.md\n```\nno\n```"
    assert files(spark, raw) == ({"model.py": "x = 2", "config.yaml": "a: 1"}, {text.DEFAULT_SUMMARY})
    # Sections win over fences, even when the text holds both.
    assert set(files(spark, raw + "\n=== FILE: one.py ===\n1")[0]) == {"one.py"}


def test_rendered_sections_come_back(spark):
    draw = random.Random(7)
    words = ["alpha", "beta = 1", "", "  indented", "# note", "=== not a marker", "`code`", "x.y", "é ü", "\t"]
    rows, truth = [], {}
    for i in range(200):
        parts, want = [draw.choice(["", "preamble. ", "Sure!\n"])], {}
        for n in range(draw.randint(1, 5)):
            name = f"f{draw.randint(0, 3)}.py"
            body = "\n".join(draw.choice(words) for _ in range(draw.randint(0, 6)))
            fence = draw.random() < 0.5
            parts.append(f"=== FILE: {name} ===\n" + (f"```python\n{body}\n```\n" if fence else body + "\n"))
            kept = body if fence else body.strip()
            if kept:
                want[name] = kept
        if want:
            rows.append((i, "\n".join(parts)))
            truth[i] = want
    got = {}
    for r in split_files(spark.createDataFrame(rows, "i int, raw string"), "raw", ["i"]).collect():
        got.setdefault(r["i"], {})[r["name"]] = r["content"]
    assert got == truth


def test_fenced_blocks_keep_the_row(spark):
    df = spark.createDataFrame([(5, "a.txt\n```\nhello\n```"), (6, "nothing")], "i int, raw string")
    assert [tuple(r) for r in fenced_blocks(df, "raw", ["i"]).collect()] == [(5, "a.txt", "hello")]


def test_json(spark):
    texts = ['```json\n{"k": 1}\n```', ' {"k": 2} ', '```\n{"k": 3}```', '{"k": ', None]
    schema = T.StructType().add("k", "long")
    got = values(spark, texts, lambda c: text.parse_json(text.strip_json_fence(c), schema))
    assert [r and r["k"] for r in got] == [1, 2, 3, None, None]
    assert got[3]["bad"] is not None and got[0]["bad"] is None


def test_front_matter(spark):
    texts = ["---\na: 1\n---\n\n body \n", "no header --- here --- x", "--- only one", "---\n---\nx --- y"]
    assert values(spark, texts, text.strip_front_matter) == ["body", texts[1], texts[2], "x --- y"]


def test_counts(spark):
    assert values(spark, ["", "a", "a\nb\n"], text.line_count) == [1, 1, 3]


def test_templates(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c string")
    line = text.fill_template("{a}-{b}: {c}!", a=F.col("a"), b=F.col("b"), c=F.col("c"))
    assert df.select(line.alias("v")).first()["v"] == "1-x: None!"
    m = F.create_map(F.lit("k"), F.col("b"), F.lit("z"), F.col("c"))
    assert df.select(text.render_map(m).alias("v")).first()["v"] == "- k: x\n- z: None"
    assert df.select(text.render_map(m, "**").alias("v")).first()["v"] == "- **k**: x\n- **z**: None"


def test_credentials(spark):
    keys = ["AIza" + "x" * 35, "short", "", None, "  " + "y" * 20 + " ", " " * 30]
    assert values(spark, keys, text.credential_ok) == [True, False, False, False, True, False]
    assert values(spark, keys, text.credential_expected_prefix) == [True, False, False, False, False, False]
    assert values(spark, ["abcdefghijklmnop", "short"], lambda c: text.mask(c, 4, 2)) == ["abcd...op", "..."]


def test_error_kind(spark):
    logs = ["docker.errors.APIError: x", "No such image: y", "no such image", "ValueError"]
    assert values(spark, logs, text.error_kind) == ["infrastructure", "infrastructure", "code", "code"]


def test_new_ids_parse(spark):
    made = spark.range(3).select(text.new_id("prj").alias("id"))
    got = made.select("id", text.id_time(F.col("id"), "prj").alias("at"), text.id_unique(F.col("id")).alias("u")).collect()
    assert all(r["at"] is not None and len(r["u"]) == 8 for r in got)
    broken = ["p-20261399-250000-0123abcd", "p-20260230-000000-0123abcd", "p-20260101-235960-0123abcd", "q-20260101-000000-0123abcd"]
    assert values(spark, broken, lambda c: text.id_time(c, "p")) == [None] * 4
    assert values(spark, ["a.b-20260102-030405-0123abcd", "axb-20260102-030405-0123abcd"], lambda c: text.id_time(c, "a.b").cast("string")) == ["2026-01-02 03:04:05", None]
    assert values(spark, ["prj-2024", "other-20240101-000000-0123abcd"], lambda c: text.id_time(c, "prj")) == [None, None]


def described(spark, turns, cap=None):
    df = spark.createDataFrame([(c, t, x) for c, t, x in turns], "conv int, turn int, content string")
    got = {}
    for r in descriptions(df, "conv", "turn", "content", cap).orderBy("conv", "turn").collect():
        got.setdefault(r["conv"], []).append(r["text"])
    return {c: "\n".join(parts) for c, parts in got.items()}


def typed(lines):
    """Brute force: stop at two blank lines in a row, drop blanks."""
    kept, blanks = [], 0
    for line in lines:
        if line.strip():
            kept.append(line)
            blanks = 0
        else:
            blanks += 1
            if blanks == 2:
                break
    return "\n".join(kept).strip()


def test_descriptions_against_brute_force(spark):
    draw = random.Random(3)
    turns, said = [], {}
    for conv in range(60):
        for turn in range(0, draw.randint(1, 9) * 2, 2):
            lines = [draw.choice(["a", "  b ", "", " ", "\t", "c c"]) for _ in range(draw.randint(1, 4))]
            turns.append((conv, turn, "\n".join(lines)))
            said.setdefault(conv, []).extend(lines)
    want = {c: typed(lines) for c, lines in said.items() if typed(lines)}
    assert described(spark, turns) == want
    assert described(spark, turns, cap=2) == want


def test_context(spark):
    requests = spark.createDataFrame([(1, "training"), (1, "training"), (2, "else")], "owner int, stage string")
    known = spark.createDataFrame([("architecture.md", "---\nx: 1\n---\nLayers")], "key string, content string")
    got = {r["owner"]: r["context"] for r in assembled_context(requests, known, "owner", "stage", F.col("name")).collect()}
    rule = "-" * 80
    assert got[1] == (
        f"### From CRITICAL-RULES.md:\n# CRITICAL-RULES.md not found\n\n{rule}\n\n"
        f"### From architecture.md:\nLayers\n\n{rule}\n\n"
        f"### From docker-patterns.md:\n# docker-patterns.md not found\n\n{rule}\n"
    )
    assert "coding-style.md" in got[2]


def test_answers(spark):
    rows = [
        (1, 1, "num_classes", "10"),
        (1, 2, "Class names", "ten"),
        (1, 3, "input size", "28x28"),
        (1, 4, "output shape", "10"),
        (1, 5, "Pretrained?", "YES please"),
        (1, 6, "Export", "ONNX"),
        (1, 7, "size", "big"),
        (1, 8, "input size", "32x32"),
        (2, 1, "classes", " 3 "),
        (2, 2, "class count", "4"),
        (2, 3, "classes", "5"),
        (3, 1, "pretrained", "no"),
        (3, 2, "input class shape", "7"),
    ]
    df = spark.createDataFrame(rows, "p int, seq int, topic string, answer string")
    got = {r["p"]: r.asDict() for r in answers_to_spec(df, "p").collect()}
    assert got[1] == dict(p=1, num_classes=10, input_shape="32x32", output_shape="10", pretrained=True, export_format="ONNX")
    # The repeated topic keeps its first place, so the topic after it wins.
    assert got[2]["num_classes"] == 4
    assert (got[3]["num_classes"], got[3]["pretrained"], got[3]["input_shape"]) == (7, False, None)


def test_answers_are_dealt_out_before_they_are_sorted(spark):
    df = spark.createDataFrame([("a", 0, "Number of classes", "3"), ("a", 1, "Batch size", "64")], "p string, seq int, topic string, answer string")
    spec = answers_to_spec(df, "p")
    assert "REPARTITION_BY_COL" in spec._jdf.queryExecution().executedPlan().toString()
    assert [r["num_classes"] for r in spec.collect()] == [3]
