"""Chat templates compiled to column expressions.

A template is data: the text of a turn, what stands before the first and behind the last one,
and whether a leading system message moves into the opening.  Texts hold fields such as
``{role}``, ``{content|trim}`` or ``{date}``; the compiler turns each text into one
concatenation of literals and columns.  Rendering gives one segment per turn with its offset
in the conversation's string, so no conversation is ever collected."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import strip_ws

_TOKEN = re.compile(r"\{\{|\}\}|\{(\w+)((?:\|\w+)*)\}|[{}]")
FILTERS = {"trim": strip_ws, "lower": F.lower, "upper": F.upper}


def compile_text(source: str, fields: Mapping[str, Column]) -> Column:
    """``source`` as an expression over ``fields`` (NULL counts as empty).  ``{{`` and ``}}`` are
    braces."""
    parts: list[Column] = []
    literal, at = "", 0
    for m in _TOKEN.finditer(source):
        literal, at = literal + source[at: m.start()], m.end()
        if m[0] in ("{{", "}}"):
            literal += m[0][0]
            continue
        if m[1] is None or m[1] not in fields:
            raise ValueError(f"no field {m[0]!r} in a template; fields are {sorted(fields)}")
        value = F.coalesce(fields[m[1]].cast("string"), F.lit(""))
        for name in m[2].split("|")[1:]:
            if name not in FILTERS:
                raise ValueError(f"no filter {name!r}; filters are {sorted(FILTERS)}")
            value = FILTERS[name](value)
        parts += [F.lit(literal), value]
        literal = ""
    parts.append(F.lit(literal + source[at:]))
    return F.concat(*parts)


@dataclass(frozen=True)
class ChatTemplate:
    """``opening`` may hold ``{system}``: the text of a leading system turn, which is then no turn
    of its own if ``lift_system``.  ``values`` are fields of all texts (dates, marks)."""

    turn: str
    opening: str = ""
    closing: str = ""
    generation: str = ""
    lift_system: bool = False
    values: Mapping[str, str] = field(default_factory=dict)

    def columns(self, role: Column, content: Column) -> tuple[Column, Column, Column]:
        """(opening without a system text, opening with this turn as system text, turn)."""
        known = {k: F.lit(v) for k, v in self.values.items()}
        turn = compile_text(self.turn, {**known, "role": role, "content": content})
        return (compile_text(self.opening, {**known, "system": F.lit("")}),
                compile_text(self.opening, {**known, "system": content}), turn)

    def ending(self, add_generation_prompt: bool) -> Column:
        known = {k: F.lit(v) for k, v in self.values.items()}
        return compile_text(self.closing + (self.generation if add_generation_prompt else ""), known)


# The texts of the two saved templates.
ROLE_MARKS = ChatTemplate(turn="<|{role}|>{content}<|end|>", generation="<|assistant|>")
HEADER_IDS = ChatTemplate(
    opening="<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\n"
            "Today Date: {date}\n\n{system|trim}<|eot_id|>",
    turn="<|start_header_id|>{role}<|end_header_id|>\n\n{content|trim}<|eot_id|>",
    generation="<|start_header_id|>assistant<|end_header_id|>\n\n",
    lift_system=True, values={"date": "26 Jul 2024"})


def render_segments(conv: DataFrame, template: ChatTemplate, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", add_generation_prompt: bool = False, block: int = 1024) -> DataFrame:
    """(conv_id, turn, offset, segment): segments in the order of their offsets make up the chat.

    The first segment begins with the opening, the last one ends with the closing.  Turns of equal
    number follow each other by role and text hash.  Offsets are prefix sums in two steps, inside
    blocks of ``block`` turn numbers and over a conversation's blocks, so a conversation of any
    length is spread over many tasks."""
    bare, lifted, body = template.columns(F.col(role), F.col(text))
    is_system = F.lit(template.lift_system) & (F.coalesce(F.col(role), F.lit("")) == "system")
    rows = conv.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.floor(F.col(turn) / F.lit(block)).alias("blk"),
                       F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.xxhash64(text).alias("h")).alias("at"),
                       body.alias("body"), is_system.alias("system"),
                       F.when(is_system, lifted).otherwise(bare).alias("opening"))
    rows = rows.withColumn("len", F.length("body").cast("long"))
    # what the opening adds, should this turn come first
    more = F.length("opening").cast("long") - F.when(F.col("system"), F.col("len")).otherwise(0)
    blocks = rows.groupBy("conv", "blk").agg(F.sum("len").alias("held"), F.min(F.struct("at", more.alias("more"))).alias("head"),
                                             F.max("at").alias("tail"))
    all_of = Window.partitionBy("conv")
    before = all_of.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "blk", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"),
                           F.min("head").over(all_of).alias("head"), F.max("tail").over(all_of).alias("tail"))
    inside = Window.partitionBy("conv", "blk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("len").over(inside), F.lit(0)))
    blocks = blocks.select(F.col("conv").alias("c"), F.col("blk").alias("b"), "start", "head", "tail")
    rows = rows.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & F.col("blk").eqNullSafe(F.col("b")))
    first, last = F.col("at") == F.col("head.at"), F.col("at") == F.col("tail")
    segment = F.concat(F.when(first, F.col("opening")).otherwise(""),
                       F.when(first & F.col("system"), "").otherwise(F.col("body")),
                       F.when(last, template.ending(add_generation_prompt)).otherwise(""))
    offset = F.when(first, F.lit(0)).otherwise(F.col("start") + F.col("inside") + F.col("head.more"))
    return rows.select(F.col("conv").alias(conv_id), F.col("turn").alias(turn), offset.cast("long").alias("offset"),
                       segment.alias("segment"))
