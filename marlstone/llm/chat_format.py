"""Chat formatting by a grammar round trip.

grammar:  chat := turn*      turn := OPEN role SAYS text CLOSE

Every turn is rendered plainly and read back by the parser of this grammar. Where
what is read differs from the source, roles and texts are escaped and the chat is
rendered and read again. An escape puts one backslash after the first character
of a control string, or of one that already carries backslashes there, so
removing one backslash restores the source whatever it held.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """open, says and close mark turns; reserved are further strings that no text may hold unescaped."""

    open: str = "<|turn|>"
    says: str = "<|says|>"
    close: str = "<|end|>"
    #: Control strings of common chat templates (fixed values).
    reserved: tuple[str, ...] = field(
        default=("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    )

    def __post_init__(self):
        strings = self.strings
        if any(len(s) < 2 or "\\" in s for s in strings):
            raise ValueError("a control string has two characters at least and no backslash")
        if any(s[0] in s[1:] for s in (self.open, self.says, self.close)) or len({self.open, self.says, self.close}) < 3:
            raise ValueError("marks must differ and must not repeat their first character")

    @property
    def strings(self) -> tuple[str, ...]:
        return (self.open, self.says, self.close, *self.reserved)

    def groups(self) -> list[tuple[str, str]]:
        """(first character, alternatives of what follows), as patterns."""
        by: dict[str, list[str]] = {}
        for s in self.strings:
            by.setdefault(s[0], []).append(re.escape(s[1:]))
        return [(re.escape(first), "|".join(sorted(rest, key=len, reverse=True))) for first, rest in by.items()]

    def escaped(self, text: Column) -> Column:
        groups = self.groups()
        pattern = "|".join(rf"({first}\\*)(?={rest})" for first, rest in groups)
        return F.regexp_replace(text, pattern, "".join(f"${i + 1}" for i in range(len(groups))) + r"\\")

    def restored(self, text: Column) -> Column:
        groups = self.groups()
        pattern = "|".join(rf"({first}\\*)\\(?={rest})" for first, rest in groups)
        return F.regexp_replace(text, pattern, "".join(f"${i + 1}" for i in range(len(groups))))

    def rendered(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.open), role, F.lit(self.says), text, F.lit(self.close))

    def parsed(self, chat: Column) -> Column:
        """array<struct<role, text, raw>> read from a rendered chat; raw is the text as it stands there."""
        pieces = F.filter(F.split(chat, re.escape(self.close)), lambda p: p.startswith(self.open))
        says = re.escape(self.says)

        def turn(piece: Column) -> Column:
            halves = F.split(F.substr(piece, F.lit(len(self.open) + 1)), says, 2)
            raw = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
            return F.struct(self.restored(F.get(halves, F.lit(0))).alias("role"), self.restored(raw).alias("text"), raw.alias("raw"))

        return F.transform(pieces, turn)


def format_chats(conversations: DataFrame, template: ChatTemplate = ChatTemplate(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conv_id from rows (conv_id, turn, role, text); other columns are ignored.

    Result: conv_id, formatted, turns array<struct<role, text>> as read back,
    loss_spans array<struct<from, to>> (code points of formatted, end excluded,
    of the texts whose role is in learn), loss_texts array<string> (those texts
    as read back), escaped boolean (escaping was needed), exact boolean (what was
    read back is the source).

    Null role or text: empty. Rows go by turn (null first), then role, then text;
    equal rows stay, each as a turn. Rows with a null conv_id form one
    conversation. An empty table gives no rows. A conversation is one output row,
    so one task holds its turns, and none of any other.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"safe_role": template.escaped(F.col("role")), "safe_text": template.escaped(F.col("text"))})
    rows = rows.withColumn("learn", F.col("role").isin(*learn))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "safe_role", "safe_text", "learn"))).alias("source"))
    wanted = F.transform("source", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    seen = lambda turns: F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    chats = chats.withColumn("plain", F.array_join(F.transform("source", lambda t: template.rendered(t.role, t.text)), ""))
    chats = chats.withColumn("escaped", seen(template.parsed(F.col("plain"))) != wanted)
    strings = "|".join(re.escape(s) for s in template.strings)
    chats = chats.withColumn("escaped", F.col("escaped") | F.exists("source", lambda t: t.text.rlike(strings) | t.role.rlike(strings)))
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), F.array_join(F.transform("source", lambda t: template.rendered(t.safe_role, t.safe_text)), "")).otherwise(F.col("plain")))
    chats = chats.withColumn("parsed", template.parsed(F.col("formatted")))
    chats = chats.withColumns({"exact": seen(F.col("parsed")) == wanted, "turns": seen(F.col("parsed"))})
    learnt = F.filter("parsed", lambda t: t.role.isin(*learn))
    chats = chats.withColumn("loss_texts", F.transform(learnt, lambda t: t.text))
    return chats.select("conv_id", "formatted", "turns", _spans(template, learn).alias("loss_spans"), "loss_texts", "escaped", "exact")


def _spans(template: ChatTemplate, learn: tuple[str, ...]) -> Column:
    """Spans of the learnt texts, from a running length over the parsed turns as they stand in formatted."""
    marks = len(template.open) + len(template.says) + len(template.close)
    head = len(template.open) + len(template.says)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<`from`:bigint,`to`:bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        role = F.char_length(F.when(t.role.isNotNull(), template.escaped(t.role)))
        text = F.char_length(t.raw)
        start = acc["at"] + head + role
        span = F.struct(start.cast("long").alias("from"), (start + text).cast("long").alias("to"))
        spans = F.when(t.role.isin(*learn), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + marks + role + text).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate("parsed", state, step, lambda acc: acc["spans"])


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns of the opN query, all taken from what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
