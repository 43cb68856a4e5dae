"""Chat formatting: a visitor over typed content parts writes each conversation once, reversibly, with a loss mask. SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the template writes; texts can't hold these, as "<" and "#" are escaped in them.
HEAD, AFTER_ROLE, TAIL = "### ", ": ", "</turn>\n"
#: Escapes, in the order they are applied; undone in reverse order.
TEXT_ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_ESCAPES = [*TEXT_ESCAPES, (":", "\\c"), ("\n", "\\n")]
#: Turns of one conversation that are put together at first, by turn number.
TURN_BLOCK = 256
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column, escapes: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for raw, code in escapes:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, escapes: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for raw, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


class PartVisitor:
    """One method a kind of part: what it writes, and how many tokens its attachment expands to. Subclass to add kinds."""

    patch = 28
    audio_tokens_a_second = 25.0
    tokens_a_page = 1024

    kinds = ("text", "image", "audio", "document")
    attached = ("image", "audio", "document")

    def write_text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def write_image(self, part: Column) -> Column:
        return F.lit("<image>")

    def write_audio(self, part: Column) -> Column:
        return F.lit("<audio>")

    def write_document(self, part: Column) -> Column:
        return F.lit("<document>")

    def tokens_image(self, part: Column) -> Column:
        side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(1)), F.lit(1)) / F.lit(self.patch))
        return side("width") * side("height")

    def tokens_audio(self, part: Column) -> Column:
        return F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_tokens_a_second), F.lit(1))

    def tokens_document(self, part: Column) -> Column:
        return F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * F.lit(self.tokens_a_page)

    def _visit(self, part: Column, method: str, kinds: tuple[str, ...], other: Column) -> Column:
        out = other
        for kind in kinds:
            visit: Callable[[Column], Column] = getattr(self, f"{method}_{kind}")
            out = F.when(part["kind"] == kind, visit(part)).otherwise(out)
        return out

    def write(self, part: Column) -> Column:
        """A part of an unknown or null kind is written as ``<part>``."""
        return self._visit(part, "write", self.kinds, F.lit("<part>"))

    def tokens(self, part: Column) -> Column:
        return self._visit(part, "tokens", self.attached, F.lit(1)).cast("long")


def format_conversations(turns: DataFrame, visitor: PartVisitor | None = None, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask, attachments, expanded_tokens: a row per conversation of ``turns`` (conv_id, turn, role, text or parts).

    ``parts`` is an array of ``PART``; a table without it has one text part a turn. The visitor writes the parts of a turn
    in order: text escaped, others as placeholders. ``attachments`` lists what the placeholders stand for, in the order in
    which they stand in ``formatted``: turn, kind, ref, tokens. ``mask`` has for each turn how many code points come
    before its content (skip), how many it has (take), and whether these count for the loss.

    Null text and role count as empty; null or empty parts write nothing. Turns are in order of turn (null first), then of role and
    content; repeated rows stay. A null conv_id is a conversation. Other columns are ignored; an empty table gives
    an empty table. Turns are put together in blocks of turn numbers first, so that a long conversation arrives at its one row as
    a few strings; that row, the result, is as long as the conversation.
    """
    visitor = visitor or PartVisitor()
    if "parts" in turns.columns:
        parts = F.coalesce(turns["parts"], F.array().cast(f"array<{PART}>"))
    else:
        parts = F.array(F.struct(F.lit("text").alias("kind"), turns["text"].alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    rows = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    attached = F.filter("parts", lambda p: ~F.coalesce(p["kind"] == "text", F.lit(False)))
    rows = rows.select(
        "conv_id",
        "turn",
        F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(AFTER_ROLE)).alias("head"),
        F.array_join(F.transform("parts", visitor.write), "").alias("content"),
        (F.col("role") == loss_role).alias("loss"),
        F.transform(attached, lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), visitor.tokens(p).alias("tokens"))).alias("attachments"),
    )
    block = F.floor(F.col("turn") / TURN_BLOCK)
    turn = F.struct("turn", "head", "content", "loss", "attachments")
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    blocks = blocks.select(
        "conv_id",
        F.struct(
            "block",
            F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["content"], F.lit(TAIL))), "").alias("formatted"),
            F.transform("t", lambda x: F.struct(F.length(x["head"]).alias("skip"), F.length(x["content"]).alias("take"), x["loss"].alias("loss"))).alias("mask"),
            F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"),
        ).alias("b"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("b", lambda x: x["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("b", lambda x: x["mask"])).alias("mask"),
        F.flatten(F.transform("b", lambda x: x["attachments"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate(F.transform("attachments", lambda a: a["tokens"]), F.lit(0).cast("long"), lambda s, x: s + x))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, content) and loss_text of :func:`format_conversations`' output, from its string and mask alone.

    The content of a text-only turn is its text; placeholders stay where they stand.
    """
    segments = F.split(F.regexp_replace("formatted", f"{TAIL}\\z", ""), TAIL)
    cut = formatted.withColumn("_s", F.when(F.size("mask") == 0, F.array().cast("array<string>")).otherwise(segments))

    def turn(s: Column) -> Column:
        colon = F.instr(s, ":")
        return F.struct(
            unescape(F.substring(s, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(s, colon + len(AFTER_ROLE), F.length(s))).alias("content"),
        )

    under = F.zip_with("_s", "mask", lambda s, m: F.when(m["loss"], F.substring(s, m["skip"] + 1, m["take"])).otherwise(F.lit("")))
    return cut.select("conv_id", F.transform("_s", turn).alias("turns"), unescape(F.array_join(under, "")).alias("loss_text"), "formatted")
