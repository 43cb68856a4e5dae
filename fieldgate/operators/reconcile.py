"""Reconciliation inside a packet's row: duplicate rows, amendments in order, totals before and after. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VALUE_FIELDS, Version
from ..functions.scalars import match_prepared, normalize_address, raw_address, trim
from .extract import NUMBER, make_field


def total(rows: Column) -> Column:
    """struct(total, unreadable) of building, contents and interruption values; null counts as zero and as unreadable."""
    values = F.flatten(F.transform(rows, lambda x: F.array(*(x[n]["value"] for n in VALUE_FIELDS))))
    return F.struct(F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0))).alias("total"), F.size(F.filter(values, lambda v: v.isNull())).alias("unreadable"))


def duplicates(rows: Column, fuzzy: bool) -> Column:
    """struct(i, keep, basis, score) per row: keep is the earliest kept row that it matches, or itself. A fold in order, not a closure."""
    keyed = F.transform(rows, lambda x, i: F.struct(i.alias("i"), raw_address(x["address"]["value"]).alias("raw"), (normalize_address(x["address"]["value"]) if fuzzy else F.lit("")).alias("norm"), trim(F.coalesce(x["zip"]["value"], F.lit(""))).alias("zip")))
    zero = F.array().cast("array<struct<i:int,raw:string,norm:string,zip:string,keep:int,basis:string,score:double>>")

    def step(done: Column, x: Column) -> Column:
        match = lambda k: match_prepared(k["raw"], k["norm"], k["zip"], x["raw"], x["norm"], x["zip"], fuzzy)
        near = F.filter(done, lambda k: (k["keep"] == k["i"]) & match(k)["match"])
        first = F.get(F.transform(near, lambda k: F.struct(k["i"].alias("i"), match(k).alias("m"))), F.lit(0))
        own = F.struct(x["i"].cast("int").alias("i"), x["raw"].alias("raw"), x["norm"].alias("norm"), x["zip"].alias("zip"), F.coalesce(first["i"], x["i"]).cast("int").alias("keep"), F.coalesce(first["m"]["basis"], F.lit("none")).alias("basis"), F.coalesce(first["m"]["score"], F.lit(0.0)).alias("score"))
        return F.concat(done, F.array(own))

    return F.aggregate(keyed, zero, step)


def resolve(extracted: DataFrame, version: Version) -> DataFrame:
    """Adds listed (locations as listed), locations (kept and amended), dup_members, removed_notes (a sentence for each row removed as a repeat), applied, unmatched, listed_tiv, computed_tiv, unreadable,
    and the computedTiv field."""
    fuzzy = version.guidelines.addressMatching == "normalized"
    rows = extracted.withColumnRenamed("locations", "listed").withColumn("_dup", duplicates(F.col("listed"), fuzzy))
    rows = rows.withColumn("dup_members", F.transform(F.filter("_dup", lambda d: d["keep"] != d["i"]), lambda d: F.struct(d["keep"].alias("keep_idx"), d["i"].alias("dup_idx"), d["basis"].alias("basis"), d["score"].alias("score"))))
    # a group's basis and score are those of the last of its members
    of_group = lambda d: F.element_at(F.filter("dup_members", lambda o: o["keep_idx"] == d["keep_idx"]), -1)
    rows = rows.withColumn("dup_members", F.transform("dup_members", lambda d: F.struct(d["keep_idx"].alias("keep_idx"), d["dup_idx"].alias("dup_idx"), of_group(d)["basis"].alias("basis"), of_group(d)["score"].alias("score"))))
    shown = lambda x: F.concat(x["loc_id"], F.lit(" ("), F.coalesce(x["address"]["value"], F.lit("null")), F.lit(")"))
    at = lambda i: F.get("listed", i)
    rows = rows.withColumn("removed_notes", F.transform(F.array_sort("dup_members", lambda a, b: a["dup_idx"] - b["dup_idx"]), lambda d: F.concat(F.lit("Removed "), shown(at(d["dup_idx"])), F.lit(" as a repeat of "), shown(at(d["keep_idx"])), F.lit(", matched on "), d["basis"], F.lit("."))))
    rows = rows.withColumn("_kept", F.filter("listed", lambda x: F.get("_dup", x["row_idx"])["keep"] == x["row_idx"]))

    def targeted(a: Column) -> Column:
        by_id = F.get(F.filter("_kept", lambda k: k["loc_id"] == a["loc_hint_id"]), F.lit(0))
        by_address = F.get(F.filter("_kept", lambda k: a["loc_hint_address"].isNotNull() & (normalize_address(k["address"]["value"]) == normalize_address(a["loc_hint_address"]))), F.lit(0))
        found = F.coalesce(by_id, by_address)
        listed = F.coalesce(*(F.when(a["target_field"] == n, found[n]["value"]) for n in VALUE_FIELDS))
        return F.struct(a.alias("a"), found["row_idx"].alias("idx"), found["loc_id"].alias("loc_id"), listed.alias("was"))

    rows = rows.withColumn("_targets", F.transform("amendments", targeted))
    rows = rows.withColumn("unmatched", F.transform(F.filter("_targets", lambda t: t["idx"].isNull()), lambda t: t["a"]["amendment_id"]))
    rows = rows.withColumn("_hits", F.filter("_targets", lambda t: t["idx"].isNotNull()))

    def applied(t: Column, i: Column) -> Column:
        before = F.filter(F.slice("_hits", F.lit(1), i), lambda b: (b["idx"] == t["idx"]) & (b["a"]["target_field"] == t["a"]["target_field"]))
        last = F.try_element_at(before, F.lit(-1))
        was = F.when(last.isNotNull(), last["a"]["to_value"]).otherwise(t["was"])
        return F.struct(t["a"]["seq"].alias("seq"), t["a"]["amendment_id"].alias("amendment_id"), t["idx"].alias("row_idx"), t["loc_id"].alias("loc_id"), t["a"]["target_field"].alias("target_field"), was.alias("from_value"), t["a"]["to_value"].alias("to_value"), t["a"]["amendment_date"].alias("amendment_date"), t["a"]["span"].alias("span"))

    rows = rows.withColumn("applied", F.transform("_hits", applied))

    def amended(x: Column) -> Column:
        for name in VALUE_FIELDS:
            last = F.try_element_at(F.filter("applied", lambda a: (a["row_idx"] == x["row_idx"]) & (a["target_field"] == name)), F.lit(-1))
            x = x.withField(name, F.when(last.isNotNull(), make_field(last["to_value"], 0.93, "endorsement", last["span"], F.concat(F.lit("amended by "), last["amendment_id"]), NUMBER)).otherwise(x[name]))
        return x

    rows = rows.withColumn("locations", F.when(F.size("applied") == 0, F.col("_kept")).otherwise(F.transform("_kept", amended)))
    before, after = total(F.col("listed")), total(F.col("locations"))
    rows = rows.withColumns({"_before": before, "_after": after})
    rows = rows.withColumns(
        {
            "listed_tiv": F.when(F.size("listed") > 0, F.col("_before.total")),
            "computed_tiv": F.when(F.size("locations") > 0, F.col("_after.total")),
            "unreadable": F.col("_after.unreadable"),
        }
    )
    known = make_field(F.col("computed_tiv"), F.when(F.col("unreadable") == 0, 0.94).otherwise(0.45), "sum:locations", kind=NUMBER)
    none = make_field(F.lit(None), 0.1, "sum:locations", kind=NUMBER)
    return rows.withColumn("computedTiv", F.when(F.col("computed_tiv").isNull(), none).otherwise(known)).drop("_dup", "_kept", "_targets", "_hits", "_before", "_after")
