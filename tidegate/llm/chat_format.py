"""Operator 2: chat formatting with Spark expressions only.

Turns are collected as structs, sorted by (turn, role, text), neighbours of
one role are merged, and everything is concatenated:

    <turn ROLE>TEXT</turn>\\n        TEXT<and>TEXT where turns were merged

``&`` and ``<`` (in roles also ``>``) are written as entities inside roles and
texts, so no text can hold a mark of the template, and parsing is exact.
Null role or text counts as empty; rows with null conv_id form one
conversation; merged texts read back with a line break between them, which
the loss mask leaves out.  Repeated rows are turns of their own; ties of turn
go by role and text; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, AND = "<turn ", "</turn>\n", "<and>"


def _escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;")) if role else c


def _unescape(c: Column) -> Column:
    for a, b in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted), one row for each conversation."""
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # Places where a role begins, and the place after its last turn.
    begins = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", i - 2)["role"]))
    turns = turns.select("conv_id", "t", begins.alias("begins"))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("t") + 1))
    turns = turns.select("conv_id", "t", "begins", ends.alias("ends"))

    def one(b: Column, e: Column) -> Column:
        texts = F.transform(F.slice("t", b, e - b), lambda x: _escape(x["text"]))
        return F.concat(F.lit(OPEN), _escape(F.get("t", b - 1)["role"], True), F.lit(">"), F.array_join(texts, AND), F.lit(CLOSE))

    return turns.select("conv_id", F.array_join(F.zip_with("begins", "ends", one), "").alias("formatted"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The rows of ``format_chats`` with turns array<struct<role, texts array<string>>> read back."""
    parts = F.filter(F.split("formatted", CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ">", 1)
        role = _unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        texts = F.transform(F.split(F.substr(p, F.length(head) + 2), AND), _unescape)
        return F.struct(role.alias("role"), texts.alias("texts"))

    return formatted.withColumn("turns", F.transform(parts, turn))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: each text of the role, nothing between."""
    own = F.filter(turns, lambda t: t["role"] == role)
    return F.array_join(F.flatten(F.transform(own, lambda t: t["texts"])), "")
