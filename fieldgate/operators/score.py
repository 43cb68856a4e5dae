"""Scoring against truth at field granularity (null is a claim), summaries and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BANDS, LOCATION_FIELDS, SCALARS, TEXT_FIELDS
from ..functions.scalars import half_up, normalize_address, trim

ITEM = "struct<key:string,expected_str:string,expected_num:bigint,actual_str:string,actual_num:bigint,correct:boolean,confidence:double,method:string>"


def same_text(a: Column, b: Column) -> Column:
    return F.lower(trim(a)).eqNullSafe(F.lower(trim(b)))


def item(key: Column, text: bool, expected: Column, field: Column, matched: Column | None = None) -> Column:
    """A scored field; without a produced row (``matched`` false) it is wrong whatever was expected."""
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    actual = field["value"]
    correct = same_text(expected, actual) if text else expected.eqNullSafe(actual)
    if matched is not None:
        correct = matched & correct
    return F.struct(
        key.alias("key"),
        (expected if text else none_s).alias("expected_str"),
        (none_n if text else expected).alias("expected_num"),
        (actual if text else none_s).alias("actual_str"),
        (none_n if text else actual).alias("actual_num"),
        correct.alias("correct"),
        F.coalesce(field["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(field["method"], F.lit("not-extracted")).alias("method"),
    ).cast(ITEM)


def assign_rows(truth: Column, produced: Column) -> Column:
    """For each truth row the index of the produced row it takes, -1 for none: the first unclaimed with the same normalised address,
    otherwise that at the same position if it is unclaimed."""
    wanted = F.transform(truth, lambda t, i: F.struct(normalize_address(t["address"]).alias("n"), i.alias("i")))
    offered = F.transform(produced, lambda p, i: F.struct(normalize_address(p["address"]["value"]).alias("n"), i.alias("i")))
    # the rows still free travel in the fold's state, so that they are normalised once and not for every truth row
    state = "struct<taken:array<int>,free:array<struct<n:string,i:int>>>"

    def step(at: Column, t: Column) -> Column:
        same = F.get(F.filter(at["free"], lambda o: o["n"] == t["n"]), F.lit(0))
        place = F.get(F.filter(at["free"], lambda o: o["i"] == t["i"]), F.lit(0))
        chosen = F.coalesce(same["i"], place["i"], F.lit(-1)).cast("int")
        return F.struct(F.concat(at["taken"], F.array(chosen)).alias("taken"), F.filter(at["free"], lambda o: o["i"] != chosen).alias("free")).cast(state)

    return F.aggregate(wanted, F.struct(F.array().cast("array<int>").alias("taken"), F.coalesce(offered, F.array()).alias("free")).cast(state), step, lambda at: at["taken"])


def score(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """version_id, packet_id, ord, key, expected_*, actual_*, correct, confidence, method: one row per scored item.

    ``truth``: packet_id, the scalars, and locations (array of structs). Runs without truth raise an error.
    """
    t = truth.select("packet_id", *(F.col(n).alias(f"t_{n}") for n in SCALARS), F.col("locations").alias("t_locations"), F.lit(True).alias("_known"))
    rows = runs.join(t, "packet_id", "left")
    rows = rows.withColumn("_known", F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("no truth for packet "), F.col("packet_id"))).cast("boolean"))).where("_known")
    rows = rows.withColumn("_taken", assign_rows(F.col("t_locations"), F.col("locations")))
    scalars = F.array(*(item(F.lit(n), n in TEXT_FIELDS, F.col(f"t_{n}"), F.col(n)) for n in SCALARS))

    def of_row(x: Column, i: Column) -> Column:
        at = F.get("_taken", i)
        p = F.get("locations", F.when(at >= 0, at))
        name = F.when(at >= 0, p["loc_id"]).otherwise(F.concat(F.lit("expected#"), (i + 1).cast("string")))
        return F.array(*(item(F.concat(name, F.lit(f".{n}")), n in TEXT_FIELDS, x[n], p[n], at >= 0) for n in LOCATION_FIELDS))

    located = F.flatten(F.transform("t_locations", of_row))
    n_truth, n_found = F.size("t_locations").cast("bigint"), F.size("locations").cast("bigint")
    count = F.struct(F.lit("locationCount").alias("key"), F.lit(None).cast("string").alias("expected_str"), n_truth.alias("expected_num"), F.lit(None).cast("string").alias("actual_str"), n_found.alias("actual_num"), (n_truth == n_found).alias("correct"), F.lit(1.0).alias("confidence"), F.lit("reconciliation").alias("method")).cast(ITEM)
    return rows.select("version_id", "packet_id", F.posexplode(F.concat(scalars, located, F.array(count))).alias("ord", "i")).select("version_id", "packet_id", "ord", "i.*")


def run_totals(scores: DataFrame) -> DataFrame:
    return scores.groupBy("version_id", "packet_id").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def summarize(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per version: packets, correct, total, accuracy, abstained, rates, decisions, cost; costs are simulated if all are.

    ``runs`` may have cost_usd and simulated (see :func:`simulated_cost`).
    """
    return summary_of(runs.select("version_id", "packet_id", "routing", *(c for c in ("cost_usd", "simulated", "latency_ms") if c in runs.columns)).join(totals, ["version_id", "packet_id"]))


def summary_of(r: DataFrame) -> DataFrame:
    """:func:`summarize` of rows that have a run's routing, correct and total."""
    decided = lambda d: F.count_if(F.col("routing.decision") == d).alias(f"n_{d}")
    more = []
    if "cost_usd" in r.columns:
        more = [half_up(F.sum("cost_usd"), 6).alias("cost_total"), half_up(F.avg("cost_usd"), 6).alias("cost_mean"), F.coalesce(F.bool_and("simulated"), F.lit(True)).alias("cost_is_simulated")]
    if "latency_ms" in r.columns:
        more += [F.sum("latency_ms").alias("latency_total"), F.avg("latency_ms").alias("latency_mean")]
    out = r.groupBy("version_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.count_if("routing.abstained").alias("abstained"), decided("quote"), decided("decline"), decided("referred"), *more)
    return out.withColumns({"accuracy": F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), "abstention_rate": F.coalesce(F.try_divide("abstained", "packets"), F.lit(0.0))})


def calibration(scores: DataFrame) -> DataFrame:
    """version_id, band, low, high, n, correct, accuracy: every band of every version, accuracy null where a band is empty."""
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for i, (lo, hi) in enumerate(BANDS)))
    placed = scores.select("version_id", "correct", sum((F.when(F.col("confidence") >= hi, 1).otherwise(0) for _, hi in BANDS[:-1]), F.lit(0)).alias("band"))
    counts = placed.groupBy("version_id", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"))
    every = scores.select("version_id").distinct().select("version_id", F.inline(bands))
    out = every.join(counts, ["version_id", "band"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "correct": F.coalesce("correct", F.lit(0))})
    return out.withColumn("accuracy", F.try_divide("correct", "n"))


def calibrated(counts: DataFrame) -> DataFrame:
    """:func:`calibration` of rows with version_id and bands, an array of struct<n,correct> in the order of ``BANDS``."""
    sums = counts.groupBy("version_id").agg(*(F.sum(F.get("bands", F.lit(i))[c]).alias(f"{c}{i}") for i in range(len(BANDS)) for c in ("n", "correct")))
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.col(f"n{i}").alias("n"), F.col(f"correct{i}").alias("correct")) for i, (lo, hi) in enumerate(BANDS)))
    return sums.select("version_id", F.inline(bands)).withColumn("accuracy", F.try_divide("correct", "n"))
