"""Rule checks, conflicts between documents, and routing. Narrow projections over a reconciled row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIDENCE_FLOOR, LOCATION_FIELDS, REQUIRED_LOCATION_FIELDS, REQUIRED_SCALARS, SOFT_LOCATION_FIELDS, SOFT_SCALARS, TIV_TOLERANCE, Guidelines, Version
from ..functions.scalars import days_between, format_usd, iso_date, months_between

SPAN = "struct<doc:string,start:int,end:int>"
SPANS = f"array<{SPAN}>"
EVIDENCE_MOST = 12


def appetite(tiv: Column, ceiling: float) -> Column:
    return F.when(tiv.isNull(), "not_evaluated").when(tiv > ceiling, "flag").otherwise("pass")


def loss_ratio(incurred: Column, tiv: Column, percent: float) -> Column:
    return F.when(incurred.isNull() | tiv.isNull() | (tiv <= 0), "not_evaluated").when(F.try_divide(incurred, tiv) * 100 > percent, "flag").otherwise("pass")


def window(effective: Column, received: Column, months: float) -> Column:
    a, b = iso_date(received), iso_date(effective)
    return F.when(a.isNull() | b.isNull(), "not_evaluated").when((days_between(a, b) < 0) | (months_between(a, b) > months), "flag").otherwise("pass")


def weak(field: Column) -> Column:
    return field["value"].isNull() | (field["confidence"] < CONFIDENCE_FLOOR)


def named(rows: Column, names: list[str], bad) -> Column:
    """'loc_id.name' of each location's fields that are ``bad``, in order."""
    return F.flatten(F.transform(rows, lambda x: F.array_compact(F.array(*(F.when(bad(x[n]), F.concat(x["loc_id"], F.lit(f".{n}"))) for n in names)))))


def hard_missing(no_rows: str) -> Column:
    scalars = F.array_compact(F.array(*(F.when(weak(F.col(n)), F.lit(n)) for n in REQUIRED_SCALARS)))
    return F.concat(scalars, F.when(F.size("locations") == 0, F.array(F.lit(no_rows))).otherwise(named(F.col("locations"), REQUIRED_LOCATION_FIELDS, weak)))


def soft_missing() -> Column:
    absent = lambda f: f["value"].isNull()
    scalars = F.array_compact(F.array(*(F.when(absent(F.col(n)), F.lit(n)) for n in SOFT_SCALARS)))
    return F.concat(scalars, named(F.col("locations"), SOFT_LOCATION_FIELDS, absent))


def members(index: str) -> Column:
    return F.transform("dup_members", lambda d: F.get("listed", d[index]))


def checks(g: Guidelines) -> Column:
    """struct(check_id, status, detail, inputs, evidence) of the five rules, in order."""

    def result(id: str, status: Column, detail: Column, inputs: dict[str, Column], evidence: Column) -> Column:
        pairs = [x for k, v in inputs.items() for x in (F.lit(k), v.cast("string"))]
        return F.struct(F.lit(id).alias("check_id"), status.alias("status"), detail.alias("detail"), F.create_map(*pairs).alias("inputs"), F.array_compact(evidence).cast(SPANS).alias("evidence"))

    tiv, incurred = F.col("computed_tiv"), F.col("lossRunTotalIncurred.value")
    buildings = F.transform("locations", lambda x: x["buildingValue"]["evidence"])
    hard, soft = hard_missing("locations"), soft_missing()
    received, effective = F.col("receivedDate.value"), F.col("requestedEffectiveDate.value")
    groups = F.size(F.array_distinct(F.transform("dup_members", lambda d: d["keep_idx"])))
    cells = F.flatten(F.transform("locations", lambda x: F.array(*(x[n]["evidence"].cast(SPAN) for n in (*REQUIRED_LOCATION_FIELDS, *SOFT_LOCATION_FIELDS)))))
    gaps = F.slice(F.array_compact(F.concat(F.array(*(F.col(n)["evidence"].cast(SPAN) for n in (*REQUIRED_SCALARS, *SOFT_SCALARS))), cells)), 1, EVIDENCE_MOST)
    both = F.array_distinct(F.concat(F.transform(members("keep_idx"), lambda x: x["source_span"]), F.transform(members("dup_idx"), lambda x: x["source_span"])))
    return F.array(
        result("GL-001", appetite(tiv, g.tivCeiling), F.concat(F.lit("insured value "), format_usd(tiv), F.lit(" against "), format_usd(F.lit(g.tivCeiling))), {"computedTiv": tiv, "ceiling": F.lit(g.tivCeiling)}, buildings),
        result("GL-002", F.when(F.size(hard) + F.size(soft) > 0, "flag").otherwise("pass"), F.concat(F.lit("missing: "), F.array_join(F.concat(hard, soft), ", ")), {"hard": F.array_join(hard, ","), "soft": F.array_join(soft, ",")}, gaps),
        result("GL-003", window(effective, received, g.maxMonthsAhead), F.concat(F.lit("effective "), F.coalesce(effective, F.lit("--")), F.lit(", received "), F.coalesce(received, F.lit("--"))), {"receivedDate": received, "effectiveDate": effective, "maxMonthsAhead": F.lit(g.maxMonthsAhead)}, F.array(F.col("receivedDate.evidence"), F.col("requestedEffectiveDate.evidence"))),
        result("GL-004", loss_ratio(incurred, tiv, g.lossRatioCeilingPct), F.concat(F.lit("incurred "), format_usd(incurred), F.lit(" of "), format_usd(tiv)), {"incurred": incurred, "computedTiv": tiv, "ceilingPct": F.lit(g.lossRatioCeilingPct)}, F.array(F.col("lossRunTotalIncurred.evidence"))),
        result("GL-005", F.when(groups > 0, "flag").otherwise("pass"), F.concat(groups.cast("string"), F.lit(" repeated locations")), {"groups": groups}, both),
    )


def conflicts() -> Column:
    """struct(conflict_id, severity, detail, evidence) of what documents disagree on, in order."""

    def found(when: Column, id: str, severity: str, detail: Column, evidence: Column) -> Column:
        one = F.struct(F.lit(id).alias("conflict_id"), F.lit(severity).alias("severity"), detail.alias("detail"), F.array_compact(evidence).cast(SPANS).alias("evidence"))
        return F.when(when, F.array(one)).otherwise(F.array().cast(f"array<struct<conflict_id:string,severity:string,detail:string,evidence:{SPANS}>>"))

    stated, computed, listed = F.col("statedTiv.value"), F.col("computed_tiv"), F.col("listed_tiv")
    gap = computed - stated
    delta = F.aggregate("applied", F.lit(0).cast("bigint"), lambda a, x: a + x["to_value"] - F.coalesce(x["from_value"], F.lit(0)))
    by_copy = (F.size("dup_members") > 0) & (F.abs(listed - stated) <= TIV_TOLERANCE)
    by_change = (F.size("applied") > 0) & (F.abs(gap - delta) <= TIV_TOLERANCE)
    mismatch = F.coalesce((F.abs(gap) > TIV_TOLERANCE) & ~F.coalesce(by_copy, F.lit(False)) & ~by_change, F.lit(False))
    received = iso_date(F.col("receivedDate.value"))
    late = F.filter("losses", lambda x: F.coalesce(iso_date(x["lossDate"]["value"]) > received, F.lit(False)))
    pairs = F.transform("dup_members", lambda d: F.struct(F.get("listed", d["keep_idx"]).alias("a"), F.get("listed", d["dup_idx"]).alias("b")))
    differ = F.filter(pairs, lambda p: ~(p["a"]["buildingValue"]["value"].eqNullSafe(p["b"]["buildingValue"]["value"]) & p["a"]["contentsValue"]["value"].eqNullSafe(p["b"]["contentsValue"]["value"]) & p["a"]["biValue"]["value"].eqNullSafe(p["b"]["biValue"]["value"])))
    disagree = F.transform(differ, lambda p: F.struct(F.lit("CF-003").alias("conflict_id"), F.lit("low").alias("severity"), F.concat(p["a"]["loc_id"], F.lit(" and "), p["b"]["loc_id"], F.lit(" have different values")).alias("detail"), F.array(p["a"]["source_span"], p["b"]["source_span"]).cast(SPANS).alias("evidence")))
    guess = lambda f: f["method"] == "context-backfill"
    guesses = F.flatten(F.transform("listed", lambda x: F.filter(F.array(*(F.when(guess(x[n]), F.concat(x["loc_id"], F.lit(f".{n}"))) for n in LOCATION_FIELDS)), lambda s: s.isNotNull())))
    guess_spans = F.flatten(F.transform("listed", lambda x: F.filter(F.array(*(F.when(guess(x[n]), x[n]["evidence"]) for n in LOCATION_FIELDS)), lambda s: s.isNotNull())))
    return F.concat(
        found(mismatch, "CF-001", "high", F.concat(F.lit("stated "), format_usd(stated), F.lit(", schedule "), format_usd(computed)), F.array(F.col("statedTiv.evidence"))),
        found(F.size(late) > 0, "CF-002", "medium", F.concat(F.size(late).cast("string"), F.lit(" claims after receipt")), F.transform(late, lambda x: x["source_span"])),
        disagree,
        found(F.size(guesses) > 0, "CF-004", "low", F.concat(F.lit("inferred: "), F.array_join(guesses, ", ")), guess_spans),
    )


def routing(g: Guidelines) -> Column:
    """struct(decision, abstained, reasons, confidence); needs the columns checks and conflicts."""
    reason = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    nothing = F.array().cast("array<struct<kind:string,detail:string>>")
    unread = hard_missing("locations (no readable rows on the schedule)")
    first = F.when(F.size(unread) > 0, F.array(reason("NOT_READABLE", F.array_join(unread, ", ")))).otherwise(nothing)
    second = F.transform(F.filter("conflicts", lambda c: c["severity"].isin("medium", "high")), lambda c: reason("UNRECONCILED", F.concat(c["conflict_id"], F.lit(": "), c["detail"])))
    incurred, listed, computed = F.col("lossRunTotalIncurred.value"), F.col("listed_tiv"), F.col("computed_tiv")
    adjusted = ((F.size("dup_members") > 0) | (F.size("applied") > 0)) & listed.isNotNull() & computed.isNotNull()
    parts = []
    for name, outcome in (("appetite", lambda t: appetite(t, g.tivCeiling)), ("loss ratio", lambda t: loss_ratio(incurred, t, g.lossRatioCeilingPct))):
        before, after = outcome(listed), outcome(computed)
        parts.append(F.when(adjusted & (before != after), F.array(reason("ADJUSTMENT_DECISIVE", F.concat(F.lit(f"{name}: "), before, F.lit(" as listed, "), after, F.lit(" as reconciled"))))).otherwise(nothing))
    reasons = F.concat(first, second, *parts)
    flagged = F.exists("checks", lambda c: c["check_id"].isin("GL-001", "GL-003", "GL-004") & (c["status"] == "flag"))
    decision = F.when(F.size(reasons) > 0, "referred").when(flagged, "decline").otherwise("quote")
    confidence = F.coalesce(F.least(*(F.col(n)["confidence"] for n in (*REQUIRED_SCALARS, "computedTiv"))), F.lit(0.0))
    return F.struct(decision.alias("decision"), (F.size(reasons) > 0).alias("abstained"), reasons.alias("reasons"), confidence.alias("confidence"))


def apply_rules(resolved: DataFrame, version: Version) -> DataFrame:
    """Adds checks, conflicts, routing and flags (the ids of flagged checks)."""
    g = version.guidelines
    rows = resolved.withColumns({"checks": checks(g), "conflicts": conflicts()})
    rows = rows.withColumn("routing", routing(g))
    return rows.withColumn("flags", F.transform(F.filter("checks", lambda c: c["status"] == "flag"), lambda c: c["check_id"]))


def low_confidence(runs: DataFrame) -> DataFrame:
    """packet_id, version_id, key, confidence, method of fields below the floor: scalars, and those of kept locations."""
    scalar = [*REQUIRED_SCALARS, "statedTiv", "computedTiv", "lossRunTotalIncurred", "lossCount"]
    item = lambda key, f: F.struct(key.alias("key"), f["confidence"].alias("confidence"), f["method"].alias("method"))
    own = F.array(*(item(F.lit(n), F.col(n)) for n in scalar))
    rows = F.flatten(F.transform("locations", lambda x: F.array(*(item(F.concat(x["loc_id"], F.lit(f".{n}")), x[n]) for n in LOCATION_FIELDS))))
    return runs.select("packet_id", "version_id", F.explode(F.filter(F.concat(own, rows), lambda i: i["confidence"] < CONFIDENCE_FLOOR)).alias("i")).select("packet_id", "version_id", "i.*")

