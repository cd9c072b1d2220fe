"""Chat formatting: a state machine checks the order of roles, a template turns turns into text segments.

The template is data: marks around a turn, the roles that carry loss and the
transitions a conversation may take. Control strings inside roles and texts are
broken up with an escape character, so that a formatted conversation can be
split into its turns again without doubt.

A conversation's turns are gathered by a partial aggregate, so a conversation
with very many rows reaches its reducer as one row per map task. Rows of equal
turn are ordered by role and text. Null role or text counts as empty; a null
turn sorts first. Rows of null conversation form one conversation. Other columns
are ignored, repeated rows are turns of their own, and a very long text is taken whole.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, loss and order. ``transitions`` maps a state to the states its next role may lead to; roles name states."""

    open: str = "<turn "
    head: str = ">\n"
    close: str = "</turn>\n"
    controls: tuple[str, ...] = ("<turn ", "</turn>", ">\n", "### System:", "### User:", "### Assistant:")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def escaped(self, text: Column) -> Column:
        out = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for mark in self.controls:
            out = F.replace(out, F.lit(mark), F.lit(mark[0] + self.escape + mark[1:]))
        return out

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, "(?s)" + re.escape(self.escape) + "(.)", "$1")

    def step(self, state: Column, role: Column) -> Column:
        """The state after ``role``: the role where the order allows it, else ``invalid``, which is never left."""
        out = F.lit("invalid")
        for source, targets in self.transitions.items():
            out = F.when((state == source) & role.isin(*targets), role).otherwise(out)
        return out


DEFAULT = Template()


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``formatted``, ``valid`` and ``first_error``, the turn index that broke the order."""
    said = rows.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    turns = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        head = F.concat(F.lit(template.open), template.escaped(t.role), F.lit(template.head))
        return F.array(
            segment(head, F.lit(False)),
            segment(template.escaped(t.text), t.role.isin(*template.loss_roles)),
            segment(F.lit(template.close), F.lit(False)),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("error"))

    def advance(s: Column, t: Column) -> Column:
        after = template.step(s.state, t.role)
        broke = F.when(s.error.isNull() & (after == "invalid"), s.n).otherwise(s.error)
        return F.struct(after.alias("state"), (s.n + 1).alias("n"), broke.alias("error"))

    walked = turns.withColumn("walk", F.aggregate("turns", start, advance)).withColumn("segments", F.flatten(F.transform("turns", of_turn)))
    return walked.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        F.col("walk.state").isin(*template.final).alias("valid"),
        F.col("walk.error").alias("first_error"),
    )


def parse_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation, control strings restored."""
    pieces = F.split(formatted, re.escape(template.close), -1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.open) + 1))
        role = F.substring_index(body, template.head, 1)
        text = F.substr(body, F.length(role) + F.lit(len(template.head) + 1))
        return F.struct(template.plain(role).alias("role"), template.plain(text).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, in order, control strings restored."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: template.plain(s.text)), "")
