"""Chat formatting from a declarative template, built from DataFrame operations only.

A template says which mark opens and closes a turn of a role, whether its text is trained on, and which role may follow
which. A state machine over the roles validates the order of turns; the formatter gives three segments per turn, its opening mark,
its text and its closing mark, with loss flags that only texts can have, and the whole text. Control strings inside texts get a backslash after their first character, one more than
they had, so that unescaping gives the text back; the parser reads turns and losses out of the formatted text alone.

Defined cases: a null or empty text is an empty turn; a null role is an empty role; roles that the template does not know
are marked by name and end in the state `invalid`; conversations out of order are formatted whole and flagged; turns
with equal numbers are ordered by role, then text; a null turn number comes first; rows without conversation id
form one conversation; an empty table gives no rows; other columns are not looked at. A conversation is one row, as its text is one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, INVALID = "start", "invalid"


@dataclass(frozen=True)
class RoleStyle:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Closing marks end with the last character of a control string and never occur in an escaped text."""

    roles: dict[str, RoleStyle] = field(
        default_factory=lambda: {
            "system": RoleStyle("[SYS] ", " [/SYS]"),
            "user": RoleStyle("[INST] ", " [/INST]"),
            "assistant": RoleStyle("[ANS] ", " </s>", loss=True),
        }
    )
    other: RoleStyle = RoleStyle("[ROLE] ", " [/ROLE]")
    name_ends: str = " [TEXT] "
    controls: tuple[str, ...] = (
        "<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[TEXT]",
    )
    moves: tuple[tuple[str, str], ...] = (
        (START, "system"), (START, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    )

    def pattern(self) -> str:
        """First character, backslashes, rest: the control strings and what they become when escaped."""
        firsts = "|".join(re.escape(c) for c in sorted({c[0] for c in self.controls}))
        rests = "|".join(re.escape(c) for c in sorted({c[1:] for c in self.controls}))
        return rf"({firsts})(\\*)({rests})"

    def turn_end(self) -> str:
        """The empty place behind a closing mark."""
        closes = [s.closes for s in (*self.roles.values(), self.other)]
        return "(?<=" + "|".join(re.escape(c) for c in closes) + ")"


def escaped(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(text, F.lit(template.pattern()), F.lit(r"$1\\$2$3"))


def unescaped(text: Column, template: ChatTemplate) -> Column:
    """Takes one backslash from every control string that has one."""
    return F.regexp_replace(text, F.lit(template.pattern().replace(r"(\\*)", r"\\(\\*)")), F.lit("$1$2$3"))


def turn_segments(role: Column, text: Column, template: ChatTemplate) -> Column:
    """The opening mark, the escaped text and the closing mark of a turn, each with its loss flag."""
    style = template.other
    opens = F.concat(F.lit(style.opens), escaped(role, template), F.lit(template.name_ends))
    closes, loss = F.lit(style.closes), F.lit(style.loss)
    for name, style in template.roles.items():
        here = role == name
        opens = F.when(here, F.lit(style.opens)).otherwise(opens)
        closes = F.when(here, F.lit(style.closes)).otherwise(closes)
        loss = F.when(here, F.lit(style.loss)).otherwise(loss)
    parts = ((opens, F.lit(False)), (escaped(text, template), loss), (closes, F.lit(False)))
    return F.array(*[F.struct(t.alias("text"), flag.alias("loss")) for t, flag in parts])


def final_state(roles: Column, template: ChatTemplate) -> Column:
    """The state machine: the role of the last turn, or `invalid` after the first move that is not allowed."""

    def move(state: Column, role: Column) -> Column:
        allowed = reduce(
            lambda a, b: a | b, [(state == before) & (role == after) for before, after in template.moves]
        )
        return F.when(allowed, role).otherwise(F.lit(INVALID))

    return F.aggregate(roles, F.lit(START), move)


def formatted(
    rows: DataFrame,
    template: ChatTemplate | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """conv_id, formatted, segments (text and loss flag, three by turn), state, valid; one row per conversation."""
    template = template or ChatTemplate()
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("row"),
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    segments = F.flatten(F.transform("rows", lambda r: turn_segments(r["role"], r["text"], template)))
    return (
        ordered.withColumns({"segments": segments, "state": final_state(F.col("rows.role"), template)})
        .withColumn("valid", F.col("state").isin([name for name, style in template.roles.items() if style.loss]))
        .select("conv_id", F.concat(F.lit("<s>"), F.array_join("segments.text", "")).alias("formatted"), "segments", "state", "valid")
    )


def parsed(text: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted text: array of role, text (both unescaped) and loss."""
    template = template or ChatTemplate()
    inner = F.substring(text, 4, 2147483647)
    turns = F.filter(F.split(inner, template.turn_end()), lambda t: t != "")

    def cut(t: Column, opens: int, closes: int) -> Column:
        return F.substring(t, F.lit(opens + 1), F.length(t) - opens - closes)

    def read(t: Column) -> Column:
        style = template.other
        body = cut(t, len(style.opens), len(style.closes))
        name_end = F.instr(body, template.name_ends)
        role = unescaped(F.substring(body, F.lit(1), name_end - 1), template)
        own = F.substring(body, name_end + len(template.name_ends), F.length(body))
        loss = F.lit(False)
        for name, style in template.roles.items():
            here = t.startswith(style.opens)
            role = F.when(here, F.lit(name)).otherwise(role)
            own = F.when(here, cut(t, len(style.opens), len(style.closes))).otherwise(own)
            loss = F.when(here, F.lit(style.loss)).otherwise(loss)
        return F.struct(role.alias("role"), unescaped(own, template).alias("text"), loss.alias("loss"))

    return F.transform(turns, read)


def digests(chats: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """What the output says, read back: the turns out of the formatted text, and all text under the segments' loss flags.

    `loss_agrees` tells that the parser finds the same text under the template's flags.
    """
    read = chats.withColumn("turns", parsed(F.col("formatted"), template))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    flagged = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template or ChatTemplate()))
    learned = F.array_join(flagged, "")
    parsed_loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        (learned == parsed_loss).alias("loss_agrees"),
        "valid",
    )
