"""Chat formatting by a finite-state machine over roles and a declarative template (DataFrame functions only).

A template names its control strings, how a turn opens, divides and closes, which roles bear loss, and which turn may
follow which. Control strings inside roles and texts are escaped reversibly: a backslash is put after their first
character, and one more where backslashes already stand there, so ordinary text isn't touched and none of the
template's marks can occur in an escaped text.

Cases: a null text or role counts as empty; rows of a conversation that share a turn number are ordered by role and text;
rows without conv_id form one conversation; other columns aren't used; an empty table gives no conversations. Conversations
with a forbidden order of roles are formatted too and have valid = false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks begin with `lead`, so that a formatted conversation can be split at it. The rest of `controls` is only escaped."""

    lead: str = "<|"
    opening: str = "turn|>"
    dividing: str = "says|>"
    closing: str = "end|>\n"
    controls: tuple[str, ...] = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: The state machine: (state, role) -> state. Anything else leads to "bad" and stays there.
    follows: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant", "user")

    def _pattern(self, extra: str) -> str:
        return "|".join(f"({re.escape(c[0])}){extra}(\\\\*)(?={re.escape(c[1:])})" for c in sorted(self.controls))

    def escape(self, text: Column) -> Column:
        groups = range(1, 2 * len(self.controls), 2)
        return F.regexp_replace(text, self._pattern(""), "".join(f"${g}" for g in groups) + "\\\\" + "".join(f"${g + 1}" for g in groups))

    def unescape(self, text: Column) -> Column:
        groups = range(1, 2 * len(self.controls), 2)
        return F.regexp_replace(text, self._pattern(r"\\"), "".join(f"${g}${g + 1}" for g in groups))


def turns(rows: DataFrame, template: Template) -> DataFrame:
    """One row for each conversation: conv_id and its turns in order."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text"))))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles."""
    table = F.create_map(*[F.lit(x) for (s, r), to in template.follows.items() for x in (f"{s}>{r}", to)])
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), r)), F.lit("bad")))


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments (text and loss flag, in order), formatted (their concatenation), valid."""
    t = template or Template()

    def parts(x: Column) -> Column:
        loss = x["role"].isin(*t.loss_roles)
        segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(segment(F.concat(F.lit(t.lead + t.opening), t.escape(x["role"]), F.lit(t.lead + t.dividing)), F.lit(False)), segment(t.escape(x["text"]), loss), segment(F.lit(t.lead + t.closing), F.lit(False)))

    made = turns(rows, t).select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), state(F.transform("turns", lambda x: x["role"]), t).isin(*t.final).alias("valid"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """formatted's columns and `read`: role and text of every turn, from the formatted string alone."""
    t = template or Template()
    pieces = F.split("formatted", re.escape(t.lead))  # "", then opening+role, dividing+text and closing of each turn
    after = lambda x, mark: t.unescape(F.substring(x, F.lit(len(mark) + 1), F.length(x)))
    with_pieces = formatted.withColumn("_pieces", pieces)
    n = F.expr("(size(_pieces) - 1) div 3")
    read = F.transform(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(after(F.get("_pieces", i * 3 + 1), t.opening).alias("role"), after(F.get("_pieces", i * 3 + 2), t.dividing).alias("text")))
    return with_pieces.withColumn("read", read).drop("_pieces")


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from its formatted string and loss flags: n_turns, digests of the turns and of the text that bears loss."""
    t = template or Template()
    back = read_back(formatted, t)
    whole = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
    return back.withColumn("_loss", learnt).select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
