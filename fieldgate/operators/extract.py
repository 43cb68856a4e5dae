"""Extraction: packet texts to typed fields with evidence, confidence and method. A narrow projection per version, no shuffle.

``packets`` has packet_id and a text column for each document kind (null where the packet has none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AMENDABLE, BACKFILL_WINDOW, CONSTRUCTION_KEYWORDS, DOCUMENTS, EARLIEST_YEAR, Version
from ..functions.scalars import currency, street_token
from ..functions.text import cells, labelled_cell, labelled_line, let, line_starts, lines, records, span

TEXT = "struct<value:string,confidence:double,method:string,note:string,evidence:struct<doc:string,start:int,end:int>>"
NUMBER = TEXT.replace("value:string", "value:bigint")


def make_field(value: Column, confidence: Column | float, method: Column | str, evidence: Column | None = None, note: Column | str | None = None, kind: str = TEXT) -> Column:
    """A field: confidence clamped to [0, 1], method 'unspecified' if null."""
    confidence = F.lit(float(confidence)) if not isinstance(confidence, Column) else confidence
    method = F.lit(method) if not isinstance(method, Column) else method
    note = note if isinstance(note, Column) else F.lit(note).cast("string")
    evidence = F.lit(None) if evidence is None else evidence
    made = F.struct(
        value.alias("value"),
        F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.coalesce(method, F.lit("unspecified")).alias("method"),
        note.alias("note"),
        evidence.cast("struct<doc:string,start:int,end:int>").alias("evidence"),
    )
    return made.cast(kind)


def missing(confidence: float, method: str, note: str | None = None, kind: str = TEXT) -> Column:
    return make_field(F.lit(None), confidence, method, None, note, kind)


def hit_span(doc: str, hit: Column) -> Column:
    return span(doc, hit["start"], hit["end"])


def labelled_field(doc: str, hit: Column, parse, failed: str | None, confidence: float, kind: str) -> Column:
    """The ladder of a labelled cell: no label, blank, unparseable, value."""

    def of(h: Column) -> Column:
        def ladder(parsed: Column) -> Column:
            out = F.when(h.isNull(), missing(0.2, "label-miss", kind=kind)).when(h["blank"], make_field(F.lit(None), 0.9, "explicit-blank", hit_span(doc, h), kind=kind))
            if failed:
                out = out.when(parsed.isNull(), missing(0.25, failed, kind=kind))
            return out.otherwise(make_field(parsed, confidence, F.concat(F.lit("label:"), h["label"]), hit_span(doc, h), kind=kind))

        return let(parse(h["raw"]), ladder)

    return let(hit, of)


def currency_field(doc: str, row: Column, aliases: list[str], mode: str) -> Column:
    return labelled_field(doc, labelled_cell(row, aliases), lambda raw: currency(raw, mode), "currency-parse-fail", 0.96, NUMBER)


def year_field(doc: str, row: Column, aliases: list[str]) -> Column:
    return labelled_field(doc, labelled_cell(row, aliases), lambda raw: F.when(raw.rlike("\\A\\d{4}\\z"), raw.try_cast("bigint")), "year-parse-fail", 0.96, NUMBER)


def text_field(doc: str, row: Column, aliases: list[str]) -> Column:
    return labelled_field(doc, labelled_cell(row, aliases), lambda raw: raw, None, 0.95, TEXT)


def application_fields(text: Column, version: Version) -> dict[str, Column]:
    labels, doc = version.profile.labels, "acord"
    absent = lambda kind: missing(0.1, "doc-missing", "application not in scope", kind)

    def one(key: str, parse, failed: str | None, confidence: float, kind: str) -> Column:
        def of(h: Column) -> Column:
            def ladder(parsed: Column) -> Column:
                out = F.when(text.isNull(), absent(kind)).when(h.isNull(), missing(0.2, "label-miss", kind=kind))
                if failed:
                    out = out.when(parsed.isNull(), missing(0.25, failed, kind=kind))
                return out.otherwise(make_field(parsed, confidence, F.concat(F.lit("label:"), h["label"]), hit_span(doc, h), kind=kind))

            return let(parse(h["raw"]), ladder)

        return let(labelled_line(text, labels[key]), of)

    iso = lambda raw: F.when(raw.rlike("\\A\\d{4}-\\d{2}-\\d{2}\\z"), raw)  # noqa: E731  the form only: impossible dates fail in the rules
    return {
        "insuredName": one("insuredName", lambda r: r, None, 0.96, TEXT),
        "receivedDate": one("receivedDate", iso, "date-parse-fail", 0.97, TEXT),
        "requestedEffectiveDate": one("effectiveDate", iso, "date-parse-fail", 0.97, TEXT),
        "statedTiv": one("statedTiv", lambda r: currency(r, version.profile.currency), "currency-parse-fail", 0.96, NUMBER),
    }


def city_state_zip(cell: Column, doc: str = "sov") -> list[Column]:
    pattern = "\\A(.+?),\\s*([A-Z]{2})\\s+(\\d{5})(?:-\\d{4})?\\z"
    where = span(doc, cell["start"], cell["end"])
    out = []
    for k, (name, confidence) in enumerate((("city", 0.96), ("state", 0.98), ("zip", 0.98)), 1):
        value = F.regexp_extract(cell["text"], pattern, k)
        field = F.when(cell.isNull(), missing(0.15, "sov-row")).when(cell["text"].rlike(pattern), make_field(value, confidence, "city-state-zip", where)).otherwise(missing(0.2, "csz-parse-fail"))
        out.append(field.alias(name))
    return out


def with_cells(text: Column, prefix: str) -> Column:
    """struct(i, record, cells) of the records of a document."""
    own = F.filter(records(text, prefix), lambda r: r.isNotNull())
    return F.transform(own, lambda r, i: F.struct(i.alias("i"), r.alias("record"), cells(r).alias("cells")))


def locations(rows: Column, version: Version) -> Column:
    labels, mode = version.profile.labels, version.profile.currency

    def one(r: Column) -> Column:
        row, at = r["cells"], lambda k: F.get(r["cells"], F.lit(k))
        address = at(2)
        return F.struct(
            r["i"].alias("row_idx"),
            F.coalesce(F.nullif(at(1)["text"], F.lit("")), F.concat(F.lit("L"), (r["i"] + 1).cast("string"))).alias("loc_id"),
            span("sov", r["record"]["start"], r["record"]["end"]).alias("source_span"),
            F.when(address.isNull(), missing(0.15, "sov-row")).otherwise(make_field(address["text"], 0.97, "sov-row", span("sov", address["start"], address["end"]))).alias("address"),
            *city_state_zip(at(3)),
            currency_field("sov", row, labels["building"], mode).alias("buildingValue"),
            currency_field("sov", row, labels["contents"], mode).alias("contentsValue"),
            currency_field("sov", row, labels["bi"], mode).alias("biValue"),
            text_field("sov", row, labels["construction"]).alias("constructionType"),
            year_field("sov", row, labels["yearBuilt"]).alias("yearBuilt"),
        )

    return F.transform(rows, one)


def losses(rows: Column, mode: str) -> Column:
    def one(r: Column) -> Column:
        row, at = r["cells"], lambda k: F.get(r["cells"], F.lit(k))
        date, cause = at(1), at(2)
        where = lambda c: span("loss_run", c["start"], c["end"])
        return F.struct(
            F.concat(F.lit("loss_run-claim-"), (r["i"] + 1).cast("string")).alias("loss_id"),
            span("loss_run", r["record"]["start"], r["record"]["end"]).alias("source_span"),
            F.when(date["text"].rlike("\\A\\d{4}-\\d{2}-\\d{2}\\z"), make_field(date["text"], 0.97, "claim-row", where(date))).otherwise(missing(0.2, "claim-row")).alias("lossDate"),
            F.when(cause.isNotNull(), make_field(cause["text"], 0.95, "claim-row", where(cause))).otherwise(missing(0.2, "claim-row")).alias("cause"),
            currency_field("loss_run", row, ["Paid"], mode).alias("paid"),
            currency_field("loss_run", row, ["Reserved"], mode).alias("reserved"),
            text_field("loss_run", row, ["Status"]).alias("status"),
        )

    return F.transform(rows, one)


def amendments(text: Column, rows: Column, mode: str) -> Column:
    pattern = "\\A(.+?)\\s*:\\s*(.+?)\\s*->\\s*(.+?)\\z"
    dated = labelled_line(text, ["Date"])
    date = F.when(dated["raw"].rlike("\\A\\d{4}-\\d{2}-\\d{2}\\z"), dated["raw"])
    names = F.create_map(*(F.lit(x) for pair in AMENDABLE.items() for x in pair))

    def one(r: Column) -> Column:
        at = lambda k: F.get(r["cells"], F.lit(k))["text"]
        part = lambda k: F.when(at(3).rlike(pattern), F.regexp_extract(at(3), pattern, k))
        return F.struct(
            r["i"].alias("seq"),
            F.concat(F.lit("end-"), (r["i"] + 1).cast("string")).alias("amendment_id"),
            date.alias("amendment_date"),
            F.nullif(at(1), F.lit("")).alias("loc_hint_id"),
            F.nullif(at(2), F.lit("")).alias("loc_hint_address"),
            F.try_element_at(names, F.lower(F.trim(part(1)))).alias("target_field"),
            currency(part(2), mode).alias("from_value"),
            currency(part(3), mode).alias("to_value"),
            span("endorsement", r["record"]["start"], r["record"]["end"]).alias("span"),
        )

    return F.filter(F.transform(rows, one), lambda a: a["target_field"].isNotNull() & a["to_value"].isNotNull())


def construction_near(email: Column, token: Column, window: int = BACKFILL_WINDOW) -> Column:
    """struct(value, start, end): around each occurrence of ``token``, in order, the first keyword of the list that the window has."""
    low, needle = F.lower(email), F.lower(token)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(F.length(low) - F.length(needle), F.lit(0))), lambda i: F.substring(low, i + 1, F.length(needle)) == needle)

    def near(i: Column) -> Column:
        start = F.greatest(i - window, F.lit(0))
        text = F.substring(email, start + 1, F.least(i + window, F.length(email)) - start)
        tests = []
        for pattern, value in CONSTRUCTION_KEYWORDS:
            p = f"(?i){pattern}"
            at = start + F.regexp_instr(text, F.lit(p)) - 1
            tests.append(F.when(text.rlike(p), F.struct(F.lit(value).alias("value"), at.cast("int").alias("start"), (at + F.length(F.regexp_extract(text, p, 0))).cast("int").alias("end"))))
        return F.coalesce(*tests)

    found = F.get(F.filter(F.transform(hits, near), lambda x: x.isNotNull()), F.lit(0))
    return F.when((F.instr(low, needle) > 0) & (needle != ""), found)


def year_note(sov: Column, loc_id: Column, as_of_year: int) -> Column:
    """struct(year, start): the first plausible year on the first line outside the rows that names the location."""
    rows = lines(sov)
    prose = F.filter(F.transform(rows, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda r: ~F.regexp_replace(r["t"], "\\A\\s+", "").startswith("LOC |"))
    named = F.get(F.filter(prose, lambda r: F.rlike(r["t"], F.concat(F.lit("\\b\\Q"), loc_id, F.lit("\\E\\b")))), F.lit(0))
    pattern = "\\b(1[89]\\d{2}|20\\d{2})\\b"
    year = F.nullif(F.regexp_extract(named["t"], pattern, 1), F.lit("")).try_cast("bigint")
    start = line_starts(rows, named["i"]) + F.instr(named["t"], year.cast("string")) - 1
    return F.when(year.between(EARLIEST_YEAR, as_of_year + 1), F.struct(year.alias("year"), start.cast("int").alias("start")))


def backfill(rows: Column, sov: Column, email: Column, as_of_year: int) -> Column:
    """Blank years and construction types inferred from prose, at confidence 0.5."""

    def one(x: Column) -> Column:
        note = year_note(sov, x["loc_id"], as_of_year)
        near = construction_near(email, street_token(x["address"]["value"]))
        year = F.when(x["yearBuilt"]["value"].isNull() & note.isNotNull(), make_field(note["year"], 0.5, "context-backfill", span("sov", note["start"], note["start"] + 4), "inferred from a note", NUMBER)).otherwise(x["yearBuilt"])
        kind = F.when(x["constructionType"]["value"].isNull() & near.isNotNull(), make_field(near["value"], 0.5, "context-backfill", hit_span("email", near), "inferred from the email")).otherwise(x["constructionType"])
        return x.withField("yearBuilt", year).withField("constructionType", kind)

    blank = lambda x: x["yearBuilt"]["value"].isNull() | x["constructionType"]["value"].isNull()
    return F.transform(rows, lambda x: F.when(blank(x), one(x)).otherwise(x))


def extract(packets: DataFrame, version: Version, as_of_year: int = 2026) -> DataFrame:
    """packet_id, version_id, the scalar fields, locations, losses, amendments, documents_read, input_chars, passes, and the texts."""
    profile = version.profile
    text = {d: F.regexp_replace(F.col(d), "\r\n", "\n") for d in DOCUMENTS}
    scope = {d: (text[d] if d in profile.documents else F.lit(None).cast("string")) for d in DOCUMENTS}
    rows = packets.select("packet_id", *(text[d].alias(d) for d in DOCUMENTS), *(scope[d].alias(f"_{d}") for d in DOCUMENTS))
    rows = rows.withColumns({"_loc": with_cells(F.col("_sov"), "LOC |"), "_claims": with_cells(F.col("_loss_run"), "CLAIM |"), "_changes": with_cells(F.col("_endorsement"), "ENDORSE |")})
    none = F.array().cast("array<struct<seq:int,amendment_id:string,amendment_date:string,loc_hint_id:string,loc_hint_address:string,target_field:string,from_value:bigint,to_value:bigint,span:struct<doc:string,start:int,end:int>>>")
    rows = rows.withColumns(
        application_fields(F.col("_acord"), version)
        | {
            "locations": locations(F.col("_loc"), version),
            "losses": losses(F.col("_claims"), profile.currency),
            "amendments": amendments(F.col("_endorsement"), F.col("_changes"), profile.currency) if profile.read_amendments else none,
        }
    )
    if profile.backfill:
        rows = rows.withColumn("locations", backfill(F.col("locations"), F.col("_sov"), F.col("_email"), as_of_year))
    amount = lambda name: F.aggregate(F.transform("losses", lambda x: F.coalesce(x[name]["value"], F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    unread = F.size(F.filter("losses", lambda x: x["paid"]["value"].isNull())) + F.size(F.filter("losses", lambda x: x["reserved"]["value"].isNull()))
    some = F.size("losses") > 0
    incurred = make_field(amount("paid") + amount("reserved"), F.when(unread == 0, 0.95).otherwise(0.6), "sum:claim-rows", F.get("losses", F.lit(0))["source_span"], kind=NUMBER)
    no_note = F.array().cast("array<string>")
    own = [F.when(F.col(f"_{d}").isNotNull(), F.lit(d)) for d in DOCUMENTS]
    return rows.select(
        "packet_id",
        F.lit(version.id).alias("version_id"),
        "insuredName",
        "receivedDate",
        "requestedEffectiveDate",
        "statedTiv",
        F.when(some, incurred).otherwise(missing(0.2, "no-loss-rows", kind=NUMBER)).alias("lossRunTotalIncurred"),
        make_field(F.size("losses").cast("bigint"), F.when(some, 0.97).otherwise(0.4), "count:claim-rows", kind=NUMBER).alias("lossCount"),
        "locations",
        "losses",
        "amendments",
        F.array_compact(F.array(*own)).alias("documents_read"),
        sum((F.coalesce(F.length(f"_{d}"), F.lit(0)) for d in DOCUMENTS), F.lit(0)).cast("bigint").alias("input_chars"),
        F.lit(profile.passes).alias("passes"),
        (no_note if profile.read_amendments else F.when(F.col("endorsement").isNotNull(), F.array(F.lit("an amendment is present but out of scope"))).otherwise(no_note)).alias("notes"),
    )
