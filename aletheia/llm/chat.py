"""Chat formatting: a role state machine and a declarative template.

DataFrame functions only.  ``segments`` turns every turn into three text
segments (opening mark, text, closing mark) with a loss flag each; the state
machine says whether the turn order is legal.  ``render`` joins the segments of
a conversation; ``read_back`` recovers turns and loss text from the output.

Control strings inside texts and roles are escaped so that no mark can occur in
them, and the escape is reversible.  A null text is empty, a null role is the
empty role; a conversation with an illegal order is formatted all the same and
marked ``valid = false`` with its first bad turn.  Turns that repeat a number
stay, ordered by (turn, role, text).  A conversation is one output row, so one
task holds one conversation; conversations are the unit of the output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class ChatTemplate:
    """``open`` + role + ``named`` + text + ``close`` for each turn.  Every mark
    must hold a character of ``escapes``, which no escaped text contains."""

    open: str = "<|"
    named: str = "|>"
    close: str = "</s>"
    #: characters of the marks -> their codes; "~" starts a code
    escapes: tuple[tuple[str, str], ...] = (("~", "~0"), ("<", "~1"), ("|", "~2"), ("[", "~3"))
    loss_roles: tuple[str, ...] = ("assistant",)
    #: role -> roles that may come before it ("" is the start)
    before: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"system": ("",), "user": ("", "system", "assistant"), "assistant": ("user",)}
    )

    def escape(self, text: Column) -> Column:
        for char, code in self.escapes:
            text = F.replace(text, F.lit(char), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for char, code in reversed(self.escapes):
            text = F.replace(text, F.lit(code), F.lit(char))
        return text


def segments(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, text, legal, segments`` where
    ``segments`` is an array of ``(text, loss)``."""
    t = template
    rows = conversations.select(
        "conv_id", "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    last = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    legal = F.lit(False)
    for role, earlier in t.before.items():
        from_start = last.isNull() if "" in earlier else F.lit(False)
        legal = legal | ((F.col("role") == role) & (from_start | F.coalesce(last.isin([e for e in earlier if e]), F.lit(False))))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return rows.withColumn("legal", legal).withColumn(
        "segments",
        F.array(
            part(F.concat(F.lit(t.open), t.escape(F.col("role")), F.lit(t.named)), F.lit(False)),
            part(t.escape(F.col("text")), F.col("role").isin(list(t.loss_roles))),
            part(F.lit(t.close), F.lit(False)),
        ),
    )


def render(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``conv_id, formatted, segments, valid, first_bad_turn``."""
    turns = segments(conversations, template)
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segments")))
    out = turns.groupBy("conv_id").agg(
        F.flatten(F.transform(rows, lambda r: r["segments"])).alias("segments"),
        F.min("legal").alias("valid"),
        F.min(F.when(~F.col("legal"), F.col("turn"))).alias("first_bad_turn"),
    )
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(rendered: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Adds ``turns`` (array of role, text), parsed from ``formatted``, and
    ``loss_text``, the unescaped text of the segments under the loss mask."""
    t = template
    quoted = lambda s: "\\Q" + s + "\\E"
    body = F.expr("filter(__parts, (p, i) -> i < size(__parts) - 1)")
    turn = lambda p: F.struct(
        t.unescape(F.get(F.split(p, quoted(t.named), 2), F.lit(0))).alias("role"),
        t.unescape(F.get(F.split(p, quoted(t.named), 2), F.lit(1))).alias("text"),
    )
    return (
        rendered.withColumn("__parts", F.split("formatted", quoted(t.close), -1))
        .withColumn("turns", F.transform(body, lambda p: turn(F.substr(p, F.lit(len(t.open) + 1)))))
        .withColumn("loss_text", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])), ""))
        .drop("__parts")
    )


def digests(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """The contract's row per conversation, from the read-back output."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read_back(render(conversations, template), template).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", "first_bad_turn",
    )
