"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names the marks around a turn and the characters that marks are made of. Those characters are
replaced inside texts and roles, so a mark can never occur in them, and the replacement can be undone.
Everything is a Spark SQL expression over one sorted array of turns per conversation.

Defined cases: a null text or role is the empty string; rows that tie on ``turn`` are ordered by role, then text,
and repeated rows are kept; null turns come first; a null ``conv_id`` is one conversation; an empty table gives an
empty result; columns beyond the four named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles that carry loss, the escapes, and the allowed role order."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    loss_roles: Sequence[str] = ("assistant",)
    #: (character, replacement); the replacement's own first character comes first.
    escapes: Sequence[tuple[str, str]] = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
    role_escapes: Sequence[tuple[str, str]] = (("\n", "&#10;"),)
    start: str = "start"
    accept: Sequence[str] = ("assistant",)
    moves: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


CHATML = Template()


def _swap(value: Column, pairs, undo: bool = False) -> Column:
    for plain, coded in reversed(list(pairs)) if undo else pairs:
        value = F.replace(value, F.lit(coded if undo else plain), F.lit(plain if undo else coded))
    return value


def escape(value: Column, t: Template = CHATML) -> Column:
    return _swap(value, t.escapes)


def unescape(value: Column, t: Template = CHATML) -> Column:
    return _swap(value, t.escapes, undo=True)


def _next_state(t: Template, state: Column, role: Column) -> Column:
    table = {f"{a} {b}": b for a, then in t.moves.items() for b in then}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.concat(state, F.lit(" "), role)), F.lit("error"))


def format_conversations(turns: DataFrame, t: Template = CHATML) -> DataFrame:
    """``(conv_id, turn, role, text)`` rows to one row per conversation.

    Returns conv_id, n_turns, valid (the machine accepted the whole role sequence), segments
    ``array<struct<text, loss>>`` and formatted (the segments' texts, concatenated).
    """
    row = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    machine = F.aggregate("turns", F.lit(t.start), lambda s, x: _next_state(t, s, x["role"]))

    def segments(x: Column) -> Column:
        role = _swap(escape(x["role"], t), t.role_escapes)
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(t.before_role), role, F.lit(t.after_role)), F.lit(False)),
            seg(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
            seg(F.lit(t.after_text), F.lit(False)),
        )

    return (
        convs.withColumn("segments", F.flatten(F.transform("turns", segments)))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            machine.isin(*t.accept).alias("valid"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_back(formatted: Column, t: Template = CHATML) -> Column:
    """Turns ``array<struct<role, text>>`` parsed from a formatted string and unescaped."""
    end = "".join("\\" + c if not c.isalnum() and c not in "\n_" else c for c in t.after_text)
    pieces = F.split(formatted, end, -1)

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(t.before_role) + 1), F.length(p))
        at = F.locate(t.after_role, body)
        role = F.substring(body, F.lit(1), at - 1)
        text = F.substring(body, at + len(t.after_role), F.length(body))
        return F.struct(unescape(_swap(role, t.role_escapes, undo=True), t).alias("role"), unescape(text, t).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
