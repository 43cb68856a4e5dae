"""Packets rendered from orders and their lines, with defects planted by arithmetic on keys, and the truth to score them against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_usd

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
#: Defects and the divisor of o_orderkey that plants each: fixed values, shared with the SQL that the queries are checked against.
DEFECTS = {"copy": 5, "alias": 7, "copy_differs": 10, "blank": 11, "gap": 13, "short": 17, "amend": 19, "total_alias": 23, "name_alias": 29, "bad_date": 31, "late_loss": 37}


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packet_id, the document texts, label, edge_cases, the truth's scalars (t_*) and t_locations: a row per order; lines are gathered by order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER, "l_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    value = lambda c: F.col(c).cast("bigint")
    row = F.struct(
        *ORDER,
        (F.floor(F.col("l_extendedprice") + 0.5) * 100).cast("bigint").alias("building"),
        (value("l_quantity") * 1000).alias("contents"),
        (F.pmod("l_partkey", F.lit(500)) * 1000).cast("bigint").alias("bi"),
    )
    grouped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    o = orders.join(grouped, "o_orderkey", "left").withColumn("k", F.col("o_orderkey").cast("bigint"))
    has = lambda name: F.pmod("k", F.lit(DEFECTS[name])) == 0
    some = F.coalesce(F.size("rows"), F.lit(0)) > 0
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Frame", "Joisted Masonry", "Non-Combustible", "Fire Resistive"))), (F.pmod("k", F.lit(4)) + 1).cast("int"))

    def location(x: Column, i: Column) -> Column:
        first = i == 0
        building = F.when(first & has("short"), F.floor(x["building"] / 100000) * 100000).otherwise(x["building"]).cast("bigint")
        amended = building + F.when(first & has("amend"), 1_000_000).otherwise(0)
        return F.struct(
            F.concat((100 + 10 * i).cast("string"), F.lit(" Quarry"), F.pmod(x["l_partkey"], F.lit(997)).cast("string"), F.lit(" Ave")).alias("address"),
            F.lit("Alton").alias("city"),
            F.lit("NY").alias("state"),
            F.lpad(F.pmod(F.col("k") * 31 + (i + 1) * 37, F.lit(100000)).cast("string"), 5, "0").alias("zip"),
            amended.alias("buildingValue"),
            x["contents"].alias("contentsValue"),
            x["bi"].alias("biValue"),
            kind.alias("constructionType"),
            F.when(~(first & has("blank")), F.lit(1950) + F.pmod(x["l_suppkey"], F.lit(70))).cast("bigint").alias("yearBuilt"),
            building.alias("listed"),
        )

    o = o.withColumn("loc", F.coalesce(F.transform("rows", location), F.array()))
    total = F.aggregate("loc", F.lit(0).cast("bigint"), lambda a, x: a + x["buildingValue"] + x["contentsValue"] + x["biValue"])
    stale = F.when(has("amend") & some, 1_000_000).otherwise(0)
    o = o.withColumns({"total": total, "n": F.size("loc")})
    o = o.withColumn("stated", (F.col("total") - stale + F.when(has("gap"), 50_000).otherwise(0)).cast("bigint"))
    claims = F.when(F.pmod("k", F.lit(4)) > 0, F.sequence(F.lit(1), F.pmod("k", F.lit(4)).cast("int"))).otherwise(F.array().cast("array<int>"))
    paid, reserved = lambda j: F.pmod("k", F.lit(97)) * 100 * j, F.pmod("k", F.lit(13)) * 50
    o = o.withColumns({"claims": claims, "incurred": F.aggregate(claims, F.lit(0).cast("bigint"), lambda a, j: a + paid(j) + reserved)})
    year = lambda d: F.date_format(d, "yyyy-MM-dd")
    effective = F.when(has("bad_date"), F.lit("2026-02-30")).otherwise(year(F.date_add("day", F.pmod("k", F.lit(500)).cast("int"))))
    o = o.withColumns({"received": year(F.col("day")), "effective": effective, "insured": F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))})

    def schedule_row(x: Column, i: Column) -> Column:
        short = F.concat(F.lit("$"), F.format_string("%.1f", x["listed"] / 1e6), F.lit("M"))
        building = F.when((i == 0) & has("short"), short).otherwise(format_usd(x["listed"]))
        return F.concat(
            F.lit("LOC | L"), (i + 1).cast("string"), F.lit(" | "), x["address"], F.lit(" | "), x["city"], F.lit(", "), x["state"], F.lit(" "), x["zip"], F.lit(" | Building: "), building, F.lit(" | Contents: "),
            format_usd(x["contentsValue"]), F.lit(" | BI: "), format_usd(x["biValue"]), F.when(has("alias"), " | Constr: ").otherwise(" | Construction: "), x["constructionType"], F.lit(" | Year Built:"), F.coalesce(F.concat(F.lit(" "), x["yearBuilt"].cast("string")), F.lit("")),
        )

    first = F.get("loc", F.lit(0))
    copy = F.concat(
        F.lit("LOC | L"), (F.col("n") + 1).cast("string"), F.lit(" | "), first["address"], F.lit("nue | "), first["city"], F.lit(", "), first["state"], F.lit(" "), first["zip"], F.lit(" | Building: "), format_usd(first["listed"]),
        F.lit(" | Contents: "), format_usd(first["contentsValue"] + F.when(has("copy_differs"), 5000).otherwise(0)), F.lit(" | BI: "), format_usd(first["biValue"]), F.when(has("alias"), " | Constr: ").otherwise(" | Construction: "), first["constructionType"], F.lit(" | Year Built: 1999"),
    )
    schedule = F.concat(F.array(F.lit("SCHEDULE OF VALUES"), F.lit("")), F.transform("loc", schedule_row), F.when(has("copy") & some, F.array(copy)).otherwise(F.array()), F.when(has("blank") & some, F.array(F.lit(""), F.lit("Note: L1 was acquired in 2019."))).otherwise(F.array()))
    late = lambda j: F.when((j == 1) & has("late_loss"), F.date_add("day", 10)).otherwise(F.date_sub("day", j * 30))
    loss_rows = F.transform("claims", lambda j: F.concat(F.lit("CLAIM | "), year(late(j)), F.lit(" | Water | Paid: "), format_usd(paid(j)), F.lit(" | Reserved: "), format_usd(reserved), F.lit(" | Status: Closed")))
    application = F.array(
        F.lit("PROPERTY APPLICATION"), F.concat(F.when(has("name_alias"), "Insured Name (DBA): ").otherwise("Named Insured: "), "insured"), F.concat(F.lit("Date Received: "), "received"), F.concat(F.lit("Proposed Effective Date: "), "effective"),
        F.concat(F.when(has("total_alias"), "TIV (stated): ").otherwise("Total Insured Value: "), format_usd(F.col("stated"))), F.lit("Deductible: $100,000 per occurrence"),
    )
    change = F.array(F.lit("ENDORSEMENT REQUEST"), F.concat(F.lit("Date: "), "received"), F.concat(F.lit("ENDORSE | L1 | "), first["address"], F.lit(" | Building: "), format_usd(first["listed"]), F.lit(" -> "), format_usd(first["buildingValue"]), F.lit(" | on bind")))
    tag = lambda name, text: F.when(has(name) & some, F.lit(text))
    return o.select(
        F.concat(F.lit("PKT-"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("packet_id"),
        F.array_join(application, "\n").alias("acord"),
        F.array_join(schedule, "\n").alias("sov"),
        F.array_join(F.concat(F.array(F.lit("LOSS RUN")), loss_rows), "\n").alias("loss_run"),
        F.when(has("amend") & some, F.array_join(change, "\n")).alias("endorsement"),
        F.lit("Renewal as discussed.").alias("email"),
        F.col("insured").alias("label"),
        F.array_compact(F.array(tag("blank", "MISSING_FIELD"), tag("copy", "DUPLICATE_LOCATION"), tag("amend", "LATE_ENDORSEMENT"), tag("gap", "CONFLICTING_LIMITS"), tag("bad_date", "INCONSISTENT_DATES"))).alias("edge_cases"),
        F.col("insured").alias("t_insuredName"),
        F.col("received").alias("t_receivedDate"),
        F.col("effective").alias("t_requestedEffectiveDate"),
        F.col("stated").alias("t_statedTiv"),
        F.when(F.col("n") > 0, F.col("total")).alias("t_computedTiv"),
        F.when(F.size("claims") > 0, F.col("incurred")).alias("t_lossRunTotalIncurred"),
        F.size("claims").cast("bigint").alias("t_lossCount"),
        F.transform("loc", lambda x: x.dropFields("listed")).alias("t_locations"),
    )


def packets_of(r: DataFrame) -> DataFrame:
    return r.select("packet_id", "acord", "sov", "loss_run", "endorsement", "email", "label", "edge_cases")


def truth_of(r: DataFrame) -> DataFrame:
    return r.select("packet_id", "label", "edge_cases", *(F.col(c).alias(c[2:]) for c in r.columns if c.startswith("t_")))
