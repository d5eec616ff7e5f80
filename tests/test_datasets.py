"""Profiles, rules, lookups, listings and manifests on small tables."""

from __future__ import annotations

import pathlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelyard.operators import checks, lifecycle, profile, splits
from modelyard.operators.checks import Rule
from modelyard.plans.readiness import issues, readiness, size_findings
from modelyard.session import discard, new_folder
from modelyard.sources import files, states, tables


def test_listing(spark, tmp_path):
    names = ("a/x.TXT", "a/y.txt", "z", "b/c/w.tar.gz", ".hidden", "_meta/z", "_y", "a/b/c/d/e/deep é.txt", "b/c/.x", "per%20cent/#1")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1234")
    listed = files.list_files(spark, str(tmp_path))
    found = {r["relative"]: (r["name"], r["ext"], r["dir"], r["length"]) for r in listed.collect()}
    assert set(found) == set(names) and listed.count() == len(names)
    assert found["a/x.TXT"] == ("x.TXT", ".txt", "a", 4) and found["z"] == ("z", "", ".", 4)
    assert found["b/c/w.tar.gz"] == ("w.tar.gz", ".gz", "b/c", 4) and found[".hidden"][2] == "."
    assert {r["relative"] for r in files.visible(listed).collect()} == set(names) - {".hidden", "b/c/.x"}
    counted = {(r["kind"], r["key"]): r["n"] for r in profile.dataset_profile(listed, F.col("relative")).collect()}
    assert (counted[("total", "")], counted[("ext", ".txt")], counted[("dir", ".")], counted[("dir", "b/c")]) == (10, 3, 3, 2)


def test_listing_of_an_empty_folder(spark, tmp_path):
    assert files.list_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception):
        files.list_files(spark, str(tmp_path / "absent")).count()


def test_a_deep_tree_and_a_large_folder_are_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    """Depth 8, half of the files in one folder: found once each, the large folder looked up page by page."""
    monkeypatch.setattr(files, "DRIVER_FOLDERS", 3)
    deep, names = tmp_path, set()
    for level in range(8):
        deep = deep / f"level{level}"
        for side in range(4):
            folder = deep / f"side{side}"
            folder.mkdir(parents=True)
            for i in range(8):
                (folder / f"f{i}.txt").write_text("x" * i)
                names.add(f"{folder.relative_to(tmp_path)}/f{i}.txt")
    for i in range(256):
        (deep / f"large{i}").write_text("12345")
        names.add(f"{deep.relative_to(tmp_path)}/large{i}")
    (deep / "loop").symlink_to(tmp_path)
    (deep / "gone").symlink_to(tmp_path / "absent")
    (deep / "file-link").symlink_to(deep / "large0")
    names.add(f"{deep.relative_to(tmp_path)}/file-link")
    looked = []
    listed = files._listed
    monkeypatch.setattr(files, "_listed", lambda frontier, *rest: looked.append(frontier.rdd.getNumPartitions()) or listed(frontier, *rest))
    found = files.list_files(spark, str(tmp_path), page=32)
    got = [r["relative"] for r in found.collect()]
    assert len(got) == len(names) and set(got) == names
    assert found.filter("name like 'large%'").agg(F.sum("length")).first()[0] == 256 * 5
    assert max(looked) >= 7 and found.rdd.getNumPartitions() > 8


def test_listing_is_not_on_the_driver(spark, sf):
    plan = files.list_files(spark, sf)._jdf.queryExecution().logical().toString()
    assert "binaryFile" not in plan and "content" not in plan


def test_sample_is_exact(spark):
    df = spark.range(200)
    assert profile.uniform_sample(df, "id").count() == 50
    assert profile.uniform_sample(df.limit(7), "id").count() == 7
    assert set(profile.uniform_sample(df, "id").collect()) == set(profile.uniform_sample(df.repartition(9), "id").collect())


def test_rules(spark):
    df = spark.createDataFrame(
        [("Vision", "pytorch", "t", 10), ("audio", "PyTorch", None, None), ("nlp", None, "t", 1), ("rl", "jax", "t", 10001)],
        "project_type string, framework string, task string, num_classes int",
    )
    got = {r["rule"]: r["violations"] for r in checks.count_violations(df, "specs", checks.SPEC_RULES).collect()}
    assert got == {
        "project_type allowed_any_case": 1, "framework allowed_any_case": 1, "task required": 1, "num_classes range": 2,
    }
    strict = checks.count_violations(df, "t", [Rule("project_type", "allowed", allowed=("vision", "nlp"))])
    assert strict.first()["violations"] == 3
    assert checks.count_violations(df, "t", [Rule("num_classes", "positive")]).first()["violations"] == 1
    with pytest.raises(ValueError):
        Rule("a", "strange").violated()


def test_roll_up(spark):
    rows = [
        ("good", "a", "error", 0), ("good", "b", "warning", 0), ("so", "a", "warning", 2), ("so", "b", "error", 0),
        ("bad", "z", "error", 1), ("bad", "y", "warning", 1),
    ]
    df = spark.createDataFrame(rows, "table string, rule string, severity string, violations bigint").withColumn("fix", F.lit("f"))
    got = {r["table"]: (r["status"], r["all_passed"], r["failing"], r["may_continue"]) for r in readiness(df).collect()}
    assert got == {"good": ("pass", True, "", True), "so": ("warn", False, "a", True), "bad": ("fail", False, "y, z", False)}
    assert {(r["table"], r["message"]) for r in issues(df).collect()} == {
        ("so", "a: 2 rows"), ("bad", "z: 1 rows"), ("bad", "y: 1 rows"),
    }


def test_sizes(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)] * 5 + [(2,)] * 9, "label int")
    counts = profile.size_check(profile.class_distribution(df, "label"), 4, 6)
    assert {r["label"]: r["severity"] for r in counts.collect()} == {0: "error", 1: "warning", 2: None}
    found = {r["severity"]: r["violations"] for r in size_findings(df, "t", "label", 4, 6).collect()}
    assert found == {"error": 1, "warning": 1}


def test_columns(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    expected = T.StructType().add("a", "long").add("b", "string").add("c", "string")
    got = [(r["column"], r["verdict"], r["filled"]) for r in checks.column_check(df, "t", expected).collect()]
    assert got == [("a", "mistyped", 2), ("b", "ok", 1), ("c", "missing", 0)]


def test_lookups(spark):
    names = spark.createDataFrame([("train.py",), ("model.py",), ("dataset.py",)], "name string")
    some = spark.createDataFrame([("model.py",), ("notes.md",)], "name string")
    assert {r["name"] for r in checks.missing_items(names, some, "name").collect()} == {"train.py", "dataset.py"}
    assert checks.any_found(names, some, "name").first()["found"]
    assert not checks.any_found(names, some.filter("name = 'notes.md'"), "name").first()["found"]
    sources = spark.createDataFrame([("MNIST",), ("mine",), (None,)], "s string")
    assert [r[0] for r in sources.select(checks.known_source(F.col("s"))).collect()] == [True, False, False]


def test_states(spark):
    assert len(lifecycle.MOVES) == 23 and len(lifecycle.STATES) == 14
    pairs = spark.createDataFrame(
        [("INIT", "SCOPING"), ("SCOPING", "SPEC_CONFIRMED"), ("DATA_REQUIRED", "DATA_VALIDATED"), ("ENV_READY", "CODE_GENERATED"),
         ("CODE_GENERATED", "MOCK_RUNNING"), ("ENV_READY", "MOCK_RUNNING"), ("INIT", "TRAINING"), ("SCOPING", "DONE"),
         ("DONE", "INIT"), ("CODE_GENERATED", "TRAINING"), ("CODE_GENERATED", "ENV_READY"), (None, "INIT")],
        "a string, b string",
    )
    got = [r[0] for r in pairs.select(lifecycle.allowed_move(F.col("a"), F.col("b"))).collect()]
    assert got == [True] * 6 + [False] * 6
    states = spark.createDataFrame([("INIT",), ("ENV_READY",), ("nowhere",)], "state string")
    actions = {r["state"]: r["action"] for r in lifecycle.next_action(states, "state").collect()}
    assert actions["nowhere"] == "Unknown state" and "generate" in actions["ENV_READY"]
    may = lifecycle.allowed_actions(states).collect()
    assert {(r["state"], r["action"]) for r in may} == {("ENV_READY", "build_environment"), ("ENV_READY", "generate_code")}


def test_split_keeps_what_the_table_says(spark):
    df = spark.createDataFrame([(1, "test"), (2, "train")], "id int, split string")
    assert splits.train_test_split(df, "id") is df
    share = splits.train_test_split(spark.range(5000), "id").filter("split = 'train'").count() / 5000
    assert 0.77 < share < 0.83


def test_manifest(spark):
    path = new_folder(spark, "manifest")
    prof = spark.createDataFrame([("ext", ".py", 2), ("total", "", 2)], tables.PROFILE_SCHEMA)
    found = spark.createDataFrame([("t", "error", "m", "f")], "table string, severity string, message string, fix string")
    tables.write_manifest(prof, found, path)
    assert sorted(tables.read_profile(spark, path).collect()) == sorted(prof.collect())
    assert tables.read_issues(spark, path).collect() == found.collect()
    discard(spark, path)
    with pytest.raises(Exception):
        tables.read_profile(spark, path).collect()
    with pytest.raises(ValueError):
        discard(spark, "/tmp")


def test_data_context(spark):
    projects = spark.createDataFrame(
        [("a", "MNIST"), ("b", "x"), ("c", "y"), ("d", "z")], "project_id string, dataset_source string"
    )
    manifests = spark.createDataFrame([("b", "{}"), ("d", "{cut")], "project_id string, manifest string")
    needs = spark.createDataFrame(
        [("b", "old"), ("c", "needs"), ("d", "other needs")], "project_id string, requirements string"
    )
    got = {r["project_id"]: r["context"] for r in tables.data_context(projects, manifests, needs).collect()}
    assert got == {"a": "Dataset source: MNIST", "b": "{}", "c": "needs", "d": "other needs"}


def test_scans_are_pruned(spark, sf):
    import __spark_entry__ as driver

    def plan(name):
        return driver.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    assert "html" not in plan("path_ext_counts")
    assert "l_orderkey" not in plan("weighted_mean")
    assert "EqualTo(role,user)" in plan("conversation_text").split("PushedFilters")[1]


def test_summaries_of_parts_add_up(spark):
    """Counts and the sample of fifty, whatever the parts, and whichever is noted twice."""
    rows = [(i if i else None, f"d{i % 7}/{'e/' if i % 3 else ''}f{i}.{'TXT' if i % 2 else 'csv'}") for i in range(300)]
    table = spark.createDataFrame(rows, "id long, path string")
    whole = sorted(map(tuple, profile.summary(table, F.col("path"), "id").collect()), key=repr)
    assert sum(r[0] == "sample" for r in whole) == 50
    path = new_folder(spark, "manifest")
    for part in (0, 1, 2, 3, 1):
        own = table.filter(F.pmod(F.coalesce("id", F.lit(0)), F.lit(3)) == part)  # the last part is empty
        tables.add_summary(profile.summary(own, F.col("path"), "id"), path, f"part {part}/é")
    assert sorted(map(tuple, tables.read_summary(spark, path).collect()), key=repr) == whole
    few = profile.summary(table.filter("id < 9"), F.col("path"), "id")
    assert few.filter("kind = 'sample'").count() == 8


@pytest.mark.parametrize("keep", [True, False])
def test_states_are_those_of_all_records_after_any_compaction(spark, keep):
    rng, path, every = random.Random(5), new_folder(spark, "states"), []
    schema = tables.STATE_SCHEMA
    assert states.current(spark, path).count() == 0
    states.compact(spark, path, keep)

    def check():
        want = lifecycle.current_state(spark.createDataFrame(every, schema), "project_id", ["at", "seq"], "state")
        got = states.current(spark, path).select("project_id", "state")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)

    for step in range(9):
        rows = [
            (rng.choice([None, "a", "b", "c", f"p{step}"]), rng.choice(["INIT", "DONE", None]), datetime(2024, 1, rng.randint(1, 9)), 100 * step + i, {"k": str(i)})
            for i in range(rng.choice([1, 6]))
        ]
        every += rows
        states.append(spark.createDataFrame(rows, schema), path)
        if step in (2, 5):
            states.compact(spark, path, keep)
        if step == 3:  # a compaction that was cut off in front of its mark
            states.current(spark, path).filter("project_id = 'a'").write.parquet(f"{path}/snapshots/lost")
        if step == 6:  # an append that was cut off
            spark.createDataFrame(rows, schema).write.json(f"{path}/records/99999-half")
            (pathlib.Path(path) / "records/99999-half/_SUCCESS").unlink()
        if step in (0, 3, 6, 8):
            check()
    states.compact(spark, path, keep)
    states.compact(spark, path, keep)
    check()
    assert states.current(spark, path).filter("spec['k'] is null").count() == 0
    assert len(list((pathlib.Path(path) / "snapshots").iterdir())) <= 2
    assert (states.records(spark, path).count() == len(every)) == keep
