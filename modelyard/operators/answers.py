"""Free answers routed to the typed fields of a specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelyard.functions.text import strip


def routed_field(topic: Column) -> Column:
    """The field a topic speaks of; the order of the tests matters."""
    t = F.lower(topic)
    return (
        F.when(t.contains("class"), "num_classes")
        .when(
            t.contains("shape") | t.contains("size"),
            F.when(t.contains("input"), "input_shape").when(t.contains("output"), "output_shape"),
        )
        .when(t.contains("pretrain"), "pretrained")
        .when(t.contains("export"), "export_format")
    )


def answers_to_spec(answers: DataFrame, project: str) -> DataFrame:
    """`(project, seq, topic, answer)` rows to one row of fields per project.

    A repeated topic keeps its first place and takes its last answer; among topics of one
    field the last place wins. A class count that is no integer changes nothing.
    """
    # Aggregates of texts are sorted: rows are dealt out first, so that no task sorts all answers made from one split of a file.
    dealt = answers.filter(routed_field(F.col("topic")).isNotNull()).repartition(project, "topic", "seq")
    by_topic = (
        dealt.groupBy(project, "topic")
        .agg(F.min("seq").alias("place"), F.max_by("answer", "seq").alias("answer"))
        .withColumn("field", routed_field(F.col("topic")))
        .withColumn("number", strip(F.col("answer")).try_cast("bigint"))
        .filter("field is not null and (field <> 'num_classes' or number is not null)")
    )

    def said(field: str, value: str) -> Column:
        return F.max_by(value, F.when(F.col("field") == field, F.col("place")))

    typed = by_topic.groupBy(project).agg(
        said("num_classes", "number").alias("num_classes"),
        said("input_shape", "answer").alias("input_shape"),
        said("output_shape", "answer").alias("output_shape"),
        F.lower(said("pretrained", "answer")).contains("yes").alias("pretrained"),
        said("export_format", "answer").alias("export_format"),
    )
    return typed.withColumn("pretrained", F.coalesce("pretrained", F.lit(False)))
