"""Chat formatting by a finite-state machine over roles, with DataFrame functions only.

A template says, per role, which strings stand before and after a turn's text
and whether the text counts for the loss.  Roles outside it are written with
their name.  Control strings inside texts get a backslash after their first
character, so that none remains; strings that already have backslashes there
get one more, which makes the escape reversible.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings without their first character, as a pattern.
_REST = r"/?s>|/?INST\]|/?<?/?(?:SYS|ROLE|TURN)>>"
CONTROL = rf"([<\[])(\\*(?:{_REST}))"
ESCAPED = rf"([<\[])\\(\\*(?:{_REST}))"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """The turns by role, and which role may follow which; '' stands for the start, ``final`` for the roles that may end."""

    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)})
    other: Turn = Turn("<<ROLE>>", "<</TURN>>")
    #: Between the name and the text of a role outside ``turns``.
    named: str = "<</ROLE>>"
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def _valid(turns: Column, t: Template) -> Column:
    """Run the roles through the machine; null is the state after a wrong turn."""
    def step(state: Column, turn: Column) -> Column:
        moves = [F.when((state == a) & turn["role"].isin(*b), turn["role"]) for a, b in t.follows.items()]
        return F.coalesce(*moves, F.lit("\0"))

    return F.aggregate(turns, F.lit(""), step).isin(*t.final)


def _segments(turn: Column, t: Template) -> Column:
    """array<struct<text, loss>> of one turn: before, text, after."""
    def three(x: Turn, before: Column) -> Column:
        plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        return F.array(plain(before), F.struct(escape(turn["text"]).alias("text"), F.lit(x.loss).alias("loss")), plain(F.lit(x.after)))

    known = [(role, three(x, F.lit(x.before))) for role, x in t.turns.items()]
    named = three(t.other, F.concat(F.lit(t.other.before), escape(turn["role"]), F.lit(t.named)))
    return reduce(lambda rest, k: F.when(turn["role"] == k[0], k[1]).otherwise(rest), known, named)


def format_chats(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, valid boolean, segments, formatted string, loss_spans.

    segments array<struct<text string, loss boolean>> make up ``formatted``;
    loss_spans array<struct<start int, length int>> are the places, in code
    points from 1, of the texts under the loss.  Turns are put in order of
    ``turn``, nulls first, ties by role and text; repeated rows are repeated
    turns.  A null text is empty, a null role an empty name.  ``valid`` says
    whether the order of roles is accepted; invalid conversations are
    formatted all the same.  One conversation is one string, so it has to fit
    one row, and is grouped by its id; nothing else is.
    """
    turns = rows.groupBy(F.col(conv).alias("_conv")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("_turns")
    )
    out = turns.select("_conv", _valid(F.col("_turns"), template).alias("valid"), F.flatten(F.transform("_turns", lambda x: _segments(x, template))).alias("segments"))
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))
    walk = lambda s, x: F.struct(
        (s["at"] + F.length(x["text"])).alias("at"),
        F.when(x["loss"], F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), F.length(x["text"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
    )
    return out.select(
        F.col("_conv").alias(conv), "valid", "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        F.aggregate("segments", start, walk, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """Parse ``formatted`` and the loss spans back: conv, turns array<struct<role, text>>, loss_texts array<string>, formatted.

    As no control string is left inside a text, the first closing string ends a turn.
    """
    quote = lambda s: r"\Q" + s + r"\E"
    every = [*template.turns.values(), template.other]
    pattern = "(?s)" + "|".join(f"{quote(x.before)}.*?{quote(x.after)}" for x in every)

    def parsed(s: Column) -> Column:
        def inner(x: Turn) -> Column:
            return F.substring(s, len(x.before) + 1, F.length(s) - len(x.before) - len(x.after))

        def of(role: Column, text: Column) -> Column:
            return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

        body, cut_at = inner(template.other), len(template.named)
        at = F.instr(body, template.named)
        rest = of(F.substring(body, F.lit(1), at - 1), F.substring(body, at + cut_at, F.length(body)))
        return reduce(lambda rest, k: F.when(s.startswith(k[1].before), of(F.lit(k[0]), inner(k[1]))).otherwise(rest), template.turns.items(), rest)

    return formatted.select(
        conv, "valid",
        F.transform(F.regexp_extract_all("formatted", F.lit(pattern), F.lit(0)), parsed).alias("turns"),
        F.transform("loss_spans", lambda p: unescape(F.substring(F.col("formatted"), p["start"], p["length"]))).alias("loss_texts"),
        "formatted",
    )
