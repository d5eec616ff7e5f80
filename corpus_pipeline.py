"""From documents to a training mix, stage by stage; every stage is written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of documents.
Rows with a null or repeated id are decided one by one. Text is never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelyard.llm import decontaminate, jaccard, language, mixing, quality
from modelyard.llm.learning import held_out
from modelyard.llm.removal import all_but_first, fresh, told_apart, without
from modelyard.session import Scratch, pinned

SURE_OF_LANGUAGE = 0.5
GOOD_ENOUGH = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose language is not told with a share of at least 0.5."""
    network = language.learned(docs, ~held_out(F.col("doc_id"), 4, 2))
    name, share = fresh("language", docs), fresh("share", docs)
    found = language.identified(docs, network, names=(name, share))
    kept = found.filter((F.col(name) != language.UNKNOWN) & (F.col(share) >= SURE_OF_LANGUAGE))
    return kept.select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.3 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learned(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    name = fresh("quality", docs)
    return quality.scored(docs, model, name=name).filter(F.col(name) >= GOOD_ENOUGH).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8 or more, the one with the smallest id stays."""
    rows, row = told_apart(docs)
    found = jaccard.linked(rows, jaccard.JaccardSettings(words=5, percent=80), doc_id=row)
    groups = pinned(found.select(F.col("doc_id").alias("member"), "component_id"))
    return without(rows, all_but_first(rows, groups, row), row).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, row = told_apart(docs)
    found = decontaminate.contamination(rows, benchmark, doc_id=row)
    return without(rows, found.filter("size(items) > 0").select("doc_id"), row).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document go into the mix."""
    return mixing.mix(docs).taken()


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
]

#: The learned stages and the hashed draws cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage has written is deleted once the next one has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        if last is not None:
            last.clear()
        last = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
