"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A conversation becomes a list of segments (text, loss). Joined they are its formatted text; the loss mask covers the
texts of trained roles and nothing else. Control characters inside roles and texts are escaped, so that a turn's marks
stand nowhere else, and `read` takes a formatted conversation apart again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, whose texts are trained on, and which turns may follow which."""

    begin: str = "### "
    after_role: str = ": "
    end: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    #: state > role -> next state
    moves: dict[str, str] = field(default_factory=lambda: {
        "start>system": "primed", "start>user": "asked", "primed>user": "asked", "asked>assistant": "answered", "answered>user": "asked",
    })
    accept: tuple[str, ...] = ("answered",)
    #: a character and what stands for it, in the order in which they are replaced; the first is the escape itself
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))

    def __post_init__(self):
        first = {c for c, _ in self.escapes}
        if not all(mark[0] in first for mark in (self.begin, self.after_role, self.end)):
            raise ValueError("every mark must begin with a character that is escaped")


def escape(text: Column, template: Template) -> Column:
    for plain, coded in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, template: Template) -> Column:
    """Every escape character begins a code, so the codes can be taken back one kind after another, the escape's own last."""
    for plain, coded in reversed(template.escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def final_state(turns: Column, template: Template) -> Column:
    """The machine's state after all turns; `error` once a turn is out of order."""
    moves = F.create_map(*(F.lit(x) for pair in template.moves.items() for x in pair))
    return F.aggregate(turns, F.lit("start"), lambda state, t: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), t["role"])), F.lit("error")))


def segments(turns: Column, template: Template) -> Column:
    """Three segments for each turn: the mark and role, the text, the closing mark."""
    def of(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template.begin), escape(t["role"], template), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, of))


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, segments, valid) from rows (conv_id, turn, role, text), one for each conversation.

    Turns go by number, then by role and text; a null number comes first; repeated rows are turns of their own. A null
    role or text is empty. `valid` says whether the machine ends in an accepting state; others are formatted all the
    same. Rows with a null conv_id are one conversation. Without rows there are none. Other columns are left out.
    """
    template = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return chats.select("conv_id", segments(F.col("turns"), template).alias("segments"), final_state(F.col("turns"), template).isin(*template.accept).alias("valid"))


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def read(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: array of (role, text), as they were before escaping."""
    template = template or Template()
    whole = F.split(formatted, f"\\Q{template.end}\\E", -1)

    def turn(x: Column) -> Column:
        at = F.position(F.lit(template.after_role), x)
        return F.struct(
            unescape(F.substr(x, F.lit(len(template.begin) + 1), at - len(template.begin) - 1), template).alias("role"),
            unescape(F.substr(x, at + len(template.after_role), F.length(x)), template).alias("text"),
        )

    return F.transform(F.slice(whole, 1, F.size(whole) - 1), turn)


def digest(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """What a reader gets back from the formatted conversations, as counts and digests."""
    template = template or Template()
    back = chats.withColumn("formatted", joined(F.col("segments"))).withColumn("turns", read(F.col("formatted"), template))
    back = back.withColumn("trained", unescape(joined(F.filter("segments", lambda s: s["loss"])), template))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
