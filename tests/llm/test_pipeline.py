"""The pipeline, stage by stage against brute force on each stage's own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as windows_of
from test_jaccard import brute as components_of

import corpus_pipeline
from modelyard.session import stored

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf), "test")
        found.append((name, docs, after))
        docs = after
    return found


def ids(table):
    return [r["doc_id"] for r in table.select("doc_id").collect()]


def test_order_and_columns(spark, sf, steps):
    names = [name for name, _, _ in steps]
    assert names == ["language ID", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0


def test_classifiers_keep_clean_documents(steps, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    _, before, after = steps[0]
    assert after.count() >= 0.97 * before.count()
    _, before, after = steps[1]
    good, bad = before.join(labels.filter("quality = 1"), "doc_id"), after.join(labels.filter("quality = 0"), "doc_id")
    assert set(ids(good)) - set(ids(after)) == set() and bad.count() <= 0.1 * labels.filter("quality = 0").count()


def test_one_document_of_each_group_stays(steps):
    _, before, after = steps[2]
    want = {c for _, _, c in components_of([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)}
    assert sorted(ids(after)) == sorted(want) and after.count() < before.count()


def test_contaminated_documents_go(steps, spark, sf):
    _, before, after = steps[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [d for d, _, _, _, _, hit in windows_of([(r["doc_id"], r["text"]) for r in before.collect()], items) if not hit]
    assert sorted(ids(after)) == sorted(want) and after.count() < before.count()


def test_mix(steps):
    _, before, after = steps[4]
    assert sorted(ids(after)) == sorted(ids(before))
    assert after.filter("taken > 3 * size").count() == 0
    total = after.agg(F.sum("size"), F.sum("taken")).first()
    assert total[0] - 60 <= total[1] <= total[0]


def test_run_gives_the_rows_of_its_stages(spark, sf, steps):
    """The registered query against the stages one by one, which are compared with brute force here."""
    found = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, steps[-1][2].select(found.columns).collect()), key=repr)


def test_columns_of_the_table_come_back_as_they_were(spark, hard, sf):
    """Columns with the names that stages would give their own keep their values."""
    mine = hard.withColumns({"_quality": F.lit("mine"), "language": F.lit("mine"), "row": F.lit("mine"), "gone": F.lit(7), "member": F.lit(8)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, mine, sf)
        assert kept.columns == mine.columns and kept.count() > 0, name
        assert kept.select("_quality", "language", "row", "gone", "member").distinct().collect() == [("mine", "mine", "mine", 7, 8)], name


def test_run_is_all_stages(spark, sf, monkeypatch):
    """Every stage in order, each on what the one before has written."""
    seen = []

    def stage(name):
        def apply(spark, docs, folder):
            seen.append((name, docs.count(), folder))
            return docs.filter(F.col("doc_id") % 3 != 0) if name != "last" else docs.select("doc_id")

        return apply

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, stage(name)) for name in ("first", "n-th stage", "last")])
    ids_left = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect())
    total = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert seen == [("first", total, sf), ("n-th stage", len(ids_left), sf), ("last", len(ids_left), sf)]
    assert ids_left == [i for i in range(total) if i % 3]


@pytest.mark.parametrize("name", list(STAGES))
def test_hard_rows(hard, empty, spark, sf, name):
    kept = STAGES[name](spark, hard, sf)
    rows = kept.collect()
    if name == "mixing sources to target weights":
        assert len(rows) == hard.count()
    else:
        assert kept.columns == hard.columns and 0 < len(rows) <= hard.count()
    if name == "n-gram Jaccard join":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (6, 7, 8, 9)) == [6]
    assert STAGES[name](spark, empty, sf).count() == 0


def words(name: str, n: int = 40) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def decided(spark, name, rows, folder):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, STAGES[name](spark, docs, folder).select("doc_id", "text").collect()), key=repr)


def test_copies_without_or_with_shared_ids_go_row_by_row(spark, tmp_path):
    near = words("a") + " end"
    rows = [
        (5, words("a")), (None, words("a")), (None, near), (7, near), (None, words("b")), (None, words("b")), (None, words("b") + " end"),
        (3, words("c")), (3, words("d")), (3, words("d")), (8, words("c")), (None, "alone"), (9, None), (None, None), (None, None), (9, None),
    ]
    kept = decided(spark, "n-gram Jaccard join", rows, str(tmp_path))
    of_b = [r for r in kept if r[1] and r[1].startswith("b0")]
    assert len(of_b) == 1 and of_b[0][0] is None
    want = [(5, words("a")), (3, words("c")), (3, words("d")), (None, "alone"), (9, None), (9, None), (None, None), (None, None)]
    assert [r for r in kept if r not in of_b] == sorted(want, key=repr)


def test_contaminated_rows_without_or_with_shared_ids_go_row_by_row(spark, tmp_path):
    spark.createDataFrame([("i", words("q", 12))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = "before " + words("q", 12) + " after"
    clean = [(None, words("a")), (3, words("b")), (3, words("c")), (4, words("d")), (None, None)]
    rows = [*clean, (None, held), (3, held), (5, held)]
    assert decided(spark, "benchmark decontamination", rows, str(tmp_path)) == sorted(clean, key=repr)
