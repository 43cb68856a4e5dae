"""Lines, cells, labels and spans of document texts as Columns. Offsets are code points from 0, ends are exclusive."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import trim

SPAN = "struct<doc:string,start:int,end:int>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it: a lambda's variable is not expanded."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text, carriage returns before line feeds gone; null gives an empty array."""
    return F.coalesce(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), F.array().cast("array<string>"))


def line_index(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` without their text, a row per line: line_no (from 1), start, end and line. Offsets are a running sum, linear in a document's lines."""
    others = [c for c in documents.columns if c != text]
    rows = documents.withColumn("_doc", F.monotonically_increasing_id()).select("_doc", *others, F.posexplode(lines(F.col(text))).alias("_i", "line"))
    before = Window.partitionBy("_doc").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line").cast("bigint") + 1).over(before), F.lit(0).cast("bigint")))
    return rows.select(*others, (F.col("_i") + 1).cast("bigint").alias("line_no"), "start", (F.col("start") + F.length("line")).alias("end"), "line")


def line_starts(rows: Column, i: Column) -> Column:
    """Where line ``i`` (from 0) of an array of lines starts."""
    return F.when(i == 0, F.lit(0)).otherwise(F.length(F.array_join(F.slice(rows, 1, i), "\n")) + 1).cast("int")


def line_at(text: Column, offset: Column) -> Column:
    """The number (from 1) of the line that holds an offset; past the end the last line."""
    head = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def span(doc: Column | str, start: Column, end: Column) -> Column:
    doc = F.lit(doc) if isinstance(doc, str) else doc
    return F.struct(doc.alias("doc"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def described(span_: Column, text: Column, name: Column) -> Column:
    """A span with its document's name, line and snippet."""
    cut = F.substring(text, span_["start"] + 1, span_["end"] - span_["start"])
    full = F.struct(span_["doc"].alias("doc_id"), name.alias("doc_name"), line_at(text, span_["start"]).alias("line"), span_["start"].alias("start"), span_["end"].alias("end"), cut.alias("snippet"))
    return F.when(span_.isNotNull(), full)


def first_match(text: Column, pattern: str) -> Column:
    """struct(value, start, end) of the first match: of its group 1, if there is one, found inside the match from the left."""
    groups = re.compile(pattern.replace("\\z", "\\Z")).groups
    whole = F.regexp_extract(text, pattern, 0)
    value = F.regexp_extract(text, pattern, 1) if groups else whole
    start = F.regexp_instr(text, F.lit(pattern)) - 1 + F.instr(whole, value) - 1
    return F.when(text.rlike(pattern), F.struct(value.alias("value"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end")))


def records(text: Column, prefix: str) -> Column:
    """struct(line_no, start, end, text) of the lines that start with ``prefix`` after white space."""

    def of(rows: Column) -> Column:
        own = F.filter(F.transform(rows, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda r: F.ltrim(r["t"]).startswith(prefix) | F.regexp_replace(r["t"], "\\A\\s+", "").startswith(prefix))
        placed = F.transform(own, lambda r: F.struct(r["i"].alias("i"), r["t"].alias("t"), line_starts(rows, r["i"]).alias("s")))
        return F.transform(placed, lambda r: F.struct((r["i"] + 1).cast("int").alias("line_no"), r["s"].alias("start"), (r["s"] + F.length(r["t"])).cast("int").alias("end"), r["t"].alias("text")))

    return let(lines(text), of)


def cells(record: Column) -> Column:
    """struct(text, start, end, label, raw, raw_start) of the cells of a |-delimited record.

    label is what stands before the first colon, in lower case, raw what stands after it; both null without a colon.
    """

    def of(parts: Column) -> Column:
        def place(part: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(0)).otherwise(F.length(F.array_join(F.slice(parts, 1, k), "|")) + 1)
            text = trim(part)
            return F.struct(part.alias("part"), text.alias("text"), F.instr(text, ":").alias("colon"), (record["start"] + before).alias("at"))

        def split(c: Column) -> Column:
            lead = F.length(c["part"]) - F.when(c["text"] == "", F.lit(0)).otherwise(F.length(F.regexp_replace(c["part"], "\\A\\s+", "")))
            raw = F.when(c["colon"] > 0, trim(F.substring(c["text"], c["colon"] + 1, F.length(c["text"]))))
            label = F.when(c["colon"] > 0, F.lower(F.rtrim(F.substring(c["text"], F.lit(1), c["colon"] - 1))))
            return F.struct(c["text"].alias("text"), (c["at"] + lead).cast("int").alias("start"), label.alias("label"), raw.alias("raw"))

        return F.transform(
            F.transform(F.transform(parts, place), split),
            lambda c: F.struct(c["text"].alias("text"), c["start"].alias("start"), (c["start"] + F.length(c["text"])).cast("int").alias("end"), c["label"].alias("label"), c["raw"].alias("raw"), (c["start"] + F.instr(c["text"], c["raw"]) - 1).cast("int").alias("raw_start")),
        )

    return let(F.split(record["text"], "\\|"), of)


def labelled_cell(row: Column, aliases: list[str]) -> Column:
    """struct(raw, start, end, label, blank) of the first cell that one of ``aliases`` labels, in any case; cells' order decides."""
    spelled: dict[str, str] = {}
    for alias in aliases:
        spelled.setdefault(alias.lower(), alias)

    def hit(cell: Column) -> Column:
        blank = cell["raw"] == ""
        name = F.lit(None).cast("string")
        for low, alias in spelled.items():
            name = F.when(cell["label"] == low, alias).otherwise(name)
        return F.struct(
            cell["raw"].alias("raw"),
            F.when(blank, cell["start"]).otherwise(cell["raw_start"]).alias("start"),
            F.when(blank, cell["end"]).otherwise(cell["raw_start"] + F.length(cell["raw"])).alias("end"),
            name.alias("label"),
            blank.alias("blank"),
        )

    return F.get(F.transform(F.filter(row, lambda c: c["label"].isin(list(spelled))), hit), F.lit(0))


def labelled_line(text: Column, aliases: list[str]) -> Column:
    """struct(raw, start, end, label) of the first line that an alias labels with a value, case as written; aliases' order decides.

    A label without a value counts as no match.
    """

    def of(rows: Column) -> Column:
        # lines with a colon, by the text before the first one: aliases have none
        def cut(t: Column, i: Column) -> Column:
            return F.struct(i.alias("i"), F.regexp_replace(F.substring_index(t, ":", 1), "\\s+\\z", "").alias("label"), F.regexp_replace(F.substring(t, F.instr(t, ":") + 1, F.length(t)), "\\A[ \\t]+|[ \\t]+\\z", "").alias("raw"), t.alias("t"))

        known = F.filter(F.transform(rows, cut), lambda r: r["label"].isin(aliases) & r["t"].contains(":") & (r["raw"] != ""))

        def order(r: Column) -> Column:
            rank = F.lit(len(aliases))
            for k, alias in reversed(list(enumerate(aliases))):
                rank = F.when(r["label"] == alias, k).otherwise(rank)
            return F.struct(rank.alias("rank"), r["i"].alias("i"), r["label"].alias("label"), r["raw"].alias("raw"), (line_starts(rows, r["i"]) + F.instr(r["t"], ":") + F.instr(F.substring(r["t"], F.instr(r["t"], ":") + 1, F.length(r["t"])), r["raw"]) - 1).cast("int").alias("start"))

        first = F.array_min(F.transform(known, order))
        return let(first, lambda h: F.when(h.isNotNull(), F.struct(h["raw"].alias("raw"), h["start"].alias("start"), (h["start"] + F.length(h["raw"])).cast("int").alias("end"), h["label"].alias("label"))))

    return F.when(text.isNotNull(), let(lines(text), of))


def quote_span(docs: list[tuple[str, Column]], quote: Column, most: int = 500) -> Column:
    """The span of a quote in the first of (doc_id, text) that has it; a quote is cut at ``most`` code points."""
    q = F.substring(quote, 1, most)
    return F.coalesce(*(F.when((q != "") & (F.instr(text, q) > 0), span(doc, F.instr(text, q) - 1, F.instr(text, q) - 1 + F.length(q))) for doc, text in docs))


def highlighted(text: Column, start: Column, end: Column) -> Column:
    """The text before, in and after a span."""
    return F.array(F.substring(text, F.lit(1), start), F.substring(text, start + 1, end - start), F.substring(text, end + 1, F.length(text)))
