"""Chat formatting: a finite-state machine over roles and a declarative template, as DataFrame expressions only.

The template is data: control strings, the machine's moves, its accepting states and the roles
that carry loss. Every conversation is formatted, valid or not; `valid` says whether the machine
accepted it, `error_turn` (from 0) where it first had no move.

Control strings cannot be forged by a text: every `<` + backslashes + `|` in a text gets one more
backslash, so no text holds `<|`, and taking one backslash away restores it. Roles are escaped in
the same way and keep their line breaks as `\\n`.

Edge cases: null text or role counts as empty; rows with a null conv_id form one conversation;
rows of one (conv_id, turn) are ordered by role, then text; null turns come first; repeated rows
are repeated turns; an empty table gives an empty result; columns other than conv_id, turn, role
and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    head_end: str = "\n"
    close: str = "<|im_end|>\n"
    start: str = "start"
    #: state, role -> next state; a missing pair is an error, which absorbs
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"})
    accept: tuple = ("assistant",)
    loss_roles: tuple = ("assistant",)


CHATML = Template()
ERROR = "error"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, valid, final_state, error_turn, segments array<struct<text, loss>>, formatted.

    `formatted` is the segments' texts joined. A conversation is one row, so its turns meet in one
    group; turns of different conversations, equal or not, never do.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))

    def step(acc: Column, t: Column) -> Column:
        to = F.coalesce(F.element_at(moves, F.concat(acc["state"], F.lit(">"), t["role"])), F.lit(ERROR))
        return F.struct(to.alias("state"), (acc["at"] + 1).alias("at"), F.when((to == ERROR) & acc["error"].isNull(), acc["at"]).otherwise(acc["error"]).alias("error"))

    def segments_of(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.open), escape_role(t["role"]), F.lit(template.head_end)), F.lit(False)),
            part(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            part(F.lit(template.close), F.lit(False)),
        )

    walked = grouped.withColumns({"ran": F.aggregate("turns", begin, step), "segments": F.flatten(F.transform("turns", segments_of))})
    return walked.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        (F.col("ran.error").isNull() & F.col("ran.state").isin(*template.accept)).alias("valid"),
        F.col("ran.state").alias("final_state"),
        F.col("ran.error").alias("error_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation."""
    pieces = F.filter(F.split(formatted, re.escape(template.open), -1), lambda p, i: i > 0)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - len(template.close))
        role = F.substring_index(body, template.head_end, 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(body, F.length(role) + 1 + len(template.head_end), F.length(body))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
