"""Texts in rows: sections, descriptions from conversations, assembled context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelyard.functions import text
from modelyard.operators.ordered import Running, running

# Documents each stage reads, in order.
STAGE_DOCUMENTS = {
    "conversation": ("CRITICAL-RULES.md", "architecture.md"),
    "scoping": ("CRITICAL-RULES.md", "architecture.md", "coding-style.md"),
    "data_requirements": ("CRITICAL-RULES.md", "architecture.md"),
    "data_validation": ("CRITICAL-RULES.md", "architecture.md"),
    "environment": ("CRITICAL-RULES.md", "architecture.md", "docker-patterns.md", "security.md"),
    "code_generation": (
        "CRITICAL-RULES.md", "architecture.md", "coding-style.md", "error-handling.md", "security.md",
    ),
    "training": ("CRITICAL-RULES.md", "architecture.md", "docker-patterns.md"),
    "inference": ("CRITICAL-RULES.md", "architecture.md", "coding-style.md", "security.md"),
}
DEFAULT_DOCUMENTS = ("CRITICAL-RULES.md", "architecture.md", "coding-style.md")


def split_files(df: DataFrame, raw: str, keep: Sequence[str]) -> DataFrame:
    """One row per file of a multi-file text: `(keep..., name, content, summary)`.

    Sections between markers come first; fenced blocks are read only where there are none.
    """
    parsed = df.select(*keep, text.several_files(F.col(raw)).alias("_parsed"))
    return parsed.select(*keep, F.inline("_parsed.files"), F.col("_parsed.summary").alias("summary"))


def fenced_blocks(df: DataFrame, raw: str, keep: Sequence[str]) -> DataFrame:
    """One row per fenced file block."""
    return df.select(*keep, F.inline(text.fenced_files(F.col(raw))))


def _blank(line: Column) -> Column:
    return text.strip(line) == ""


def _blank_marks(turns: DataFrame, conversation: str, turn: str, content: str) -> DataFrame:
    """What the blank lines of each turn look like; narrow rows without the text."""
    blank = F.col("_blank")
    pair = F.transform(blank, lambda b, i: F.when((i > 0) & b & F.get(blank, i - 1), i))
    return turns.select(
        conversation, turn, F.transform(F.split(F.col(content), "\n", -1), _blank).alias("_blank")
    ).select(
        conversation,
        turn,
        F.get(blank, F.lit(0)).alias("_opens_blank"),
        F.element_at(blank, -1).alias("_ends_blank"),
        F.array_min(pair).alias("_pair"),
        F.nullif(F.array_position(blank, F.lit(False)), F.lit(0)).alias("_first_text"),
    )


def descriptions(
    turns: DataFrame, conversation: str, turn: str, content: str, max_rows_per_key: int | None = None
) -> DataFrame:
    """What was said up to the first two blank lines in a row, blank lines dropped.

    One row per turn that contributes, in the order of `turn`; put together with line breaks
    they are the description. A conversation without rows has an empty one and is rejected.
    Where a conversation starts and stops is worked out on narrow rows, so that the texts
    themselves meet one join by conversation only.
    """
    marks = _blank_marks(turns, conversation, turn, content)
    before = [Running("_blank_before", "previous", F.col("_ends_blank"))]
    across = F.col("_opens_blank") & F.coalesce(F.col("_blank_before"), F.lit(False))
    marked = running(marks, [conversation], [turn], before, max_rows_per_key, sized_by=turns).select(
        conversation, turn, "_first_text", F.when(across, 0).otherwise(F.col("_pair")).alias("_at")
    )
    stopped = [Running("_stopped", "max", F.col("_at").isNotNull().cast("int"), before=True)]
    said = F.col("_first_text").isNotNull() & (F.col("_at").isNull() | (F.col("_first_text") <= F.col("_at")))
    ends = (
        running(marked, [conversation], [turn], stopped, max_rows_per_key, sized_by=turns)
        .filter(F.coalesce(F.col("_stopped"), F.lit(0)) == 0)
        .groupBy(conversation)
        .agg(
            F.min(F.when(said, F.col(turn))).alias("_first"),
            F.max(F.when(said, F.col(turn))).alias("_last"),
            F.max(F.when(F.col("_at").isNotNull(), F.col(turn))).alias("_stop_turn"),
            F.max("_at").alias("_stop_at"),
        )
        .filter("_first is not null")
    )
    lines = F.split(F.col(content), "\n", -1)
    heard = F.when(F.col(turn) == F.col("_stop_turn"), F.slice(lines, F.lit(1), F.col("_stop_at"))).otherwise(lines)
    kept = F.array_join(F.filter(heard, lambda line: ~_blank(line)), "\n")
    whole = F.col("text")
    whole = F.when(F.col(turn) == F.col("_first"), F.ltrim(whole, F.lit(text.WHITE_SPACE))).otherwise(whole)
    whole = F.when(F.col(turn) == F.col("_last"), F.rtrim(whole, F.lit(text.WHITE_SPACE))).otherwise(whole)
    # Exploding an array of one or none evaluates the text once and drops turns without any.
    heard_text = F.explode(F.filter(F.array(kept), lambda t: t != ""))
    return (
        turns.join(ends, conversation)
        .filter(F.col(turn).between(F.col("_first"), F.col("_last")))
        .select(conversation, turn, "_first", "_last", heard_text.alias("text"))
        .select(conversation, turn, whole.alias("text"))
    )


def rejected(turns: DataFrame, described: DataFrame, conversation: str) -> DataFrame:
    """Conversations with rows but without a description, one row each."""
    return turns.select(conversation).distinct().join(described.select(conversation), conversation, "left_anti")


def stage_documents(stage: Column) -> Column:
    """Names of the documents a stage reads; an unknown stage reads the default list."""
    names = F.array(*[F.lit(n) for n in DEFAULT_DOCUMENTS])
    for known, wanted in STAGE_DOCUMENTS.items():
        names = F.when(stage == known, F.array(*[F.lit(n) for n in wanted])).otherwise(names)
    return names


def assembled_context(
    requests: DataFrame, documents: DataFrame, owner: str, stage: str, document: Column, opening: str = ""
) -> DataFrame:
    """The documents of each request in list order as one text `(owner, stage, context)`.

    `document` turns the listed name (column `name`) into the key that `documents`
    `(key, content)`, one row per key, is looked up by. A list has five names at most, which
    bounds the group. `opening` goes before the first of them.
    """
    wanted = requests.select(owner, stage).distinct().select(
        owner, stage, F.posexplode(stage_documents(F.col(stage))).alias("position", "name")
    ).withColumn("key", document)
    body = F.coalesce(text.strip_front_matter(F.col("content")), F.concat(F.lit("# "), "name", F.lit(" not found")))
    part = F.concat(F.lit("### From "), "name", F.lit(":\n"), body, F.lit("\n\n" + "-" * 80 + "\n"))
    return (
        wanted.join(documents.select("key", "content"), "key", "left")
        .groupBy(owner, stage)
        .agg(F.array_sort(F.collect_list(F.struct("position", part.alias("part")))).alias("parts"))
        .select(owner, stage, F.concat(F.lit(opening), F.array_join(F.col("parts.part"), "\n")).alias("context"))
    )
