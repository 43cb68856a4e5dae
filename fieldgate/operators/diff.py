"""Comparison of two versions' scores: movements, the release gate, slices; and drills that mutate scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up


def one_per_key(scores: DataFrame) -> DataFrame:
    """Repeated keys of a packet collapse to the last."""
    return scores.groupBy("packet_id", "key").agg(F.max_by(F.struct("ord", "correct", "expected_str", "expected_num", "actual_str", "actual_num", "confidence", "method"), "ord").alias("s")).select("packet_id", "key", "s.*")


def movements(baseline: DataFrame, candidate: DataFrame, strict: bool = False) -> DataFrame:
    """packet_id, ord, key, kind ('regression' or 'improvement') and both sides of fields whose correctness differs.

    A key on one side only is skipped; with ``strict`` a lost correct key is a regression and a new correct one an improvement.
    """
    b, c = one_per_key(baseline), one_per_key(candidate)
    sides = [f"b.{n} AS baseline_{n}" for n in ("actual_str", "actual_num", "correct", "confidence", "method")] + [f"c.{n} AS candidate_{n}" for n in ("actual_str", "actual_num", "correct", "confidence", "method")]
    joined = b.alias("b").join(c.alias("c"), ["packet_id", "key"], "full_outer" if strict else "inner")
    out = joined.selectExpr("packet_id", "key", "coalesce(c.ord, b.ord) AS ord", "coalesce(c.expected_str, b.expected_str) AS expected_str", "coalesce(c.expected_num, b.expected_num) AS expected_num", *sides)
    was, now = F.coalesce("baseline_correct", F.lit(False)), F.coalesce("candidate_correct", F.lit(False))
    return out.where(was != now).withColumn("kind", F.when(now, "improvement").otherwise("regression"))


def gate(moves: DataFrame) -> DataFrame:
    """One row: regressions, improvements, net and the verdict, clean only without a regression."""
    out = moves.agg(F.count_if(F.col("kind") == "regression").alias("regressions"), F.count_if(F.col("kind") == "improvement").alias("improvements"))
    return out.withColumns({"net": F.col("improvements") - F.col("regressions"), "verdict": F.when(F.col("regressions") == 0, "clean").otherwise("regressed")})


def gates(counts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """:func:`gate` of each pair of versions, from regressions and improvements by baseline, candidate and packet; a pair without a packet is clean."""
    every = F.array(*(F.struct(F.lit(a).alias("baseline"), F.lit(b).alias("candidate")) for a, b in pairs))
    sums = counts.groupBy("baseline", "candidate").agg(F.sum("regressions").alias("r"), F.sum("improvements").alias("i"))
    found = sums.agg(F.collect_list(F.struct("baseline", "candidate", "r", "i")).alias("g")).select("g", F.inline(every))
    own = F.get(F.filter("g", lambda x: (x["baseline"] == F.col("baseline")) & (x["candidate"] == F.col("candidate"))), F.lit(0))
    out = found.select("baseline", "candidate", F.coalesce(own["r"], F.lit(0)).alias("regressions"), F.coalesce(own["i"], F.lit(0)).alias("improvements"))
    return out.withColumns({"net": F.col("improvements") - F.col("regressions"), "verdict": F.when(F.col("regressions") == 0, "clean").otherwise("regressed")})


def packet_changes(rows: DataFrame) -> DataFrame:
    """:func:`compare_packets` of rows that have both runs (routing and flags of baseline_run and candidate_run), regressions and improvements."""
    side = lambda n: [F.col(f"{n}_run.routing.decision").alias(f"{n}_decision"), F.col(f"{n}_run.routing.abstained").alias(f"{n}_abstained"), F.col(f"{n}_run.flags").alias(f"{n}_flags")]
    return _changes(rows.select("packet_id", *side("baseline"), *side("candidate"), "regressions", "improvements"))


def _changes(out: DataFrame) -> DataFrame:
    changed = (F.col("baseline_decision") != F.col("candidate_decision")) | (F.col("baseline_abstained") != F.col("candidate_abstained"))
    return out.withColumns({"routing_changed": changed, "flags_added": F.array_except("candidate_flags", "baseline_flags"), "flags_removed": F.array_except("baseline_flags", "candidate_flags"), "net": F.col("improvements") - F.col("regressions")})


def compare_packets(baseline: DataFrame, candidate: DataFrame, moves: DataFrame) -> DataFrame:
    """A row per packet that both ran: decisions, whether routing changed, flags added and removed, regressions, improvements, net."""
    side = lambda df, n: df.select("packet_id", F.col("routing.decision").alias(f"{n}_decision"), F.col("routing.abstained").alias(f"{n}_abstained"), F.col("flags").alias(f"{n}_flags"))
    both = side(baseline, "baseline").join(side(candidate, "candidate"), "packet_id")
    counts = moves.groupBy("packet_id").agg(F.count_if(F.col("kind") == "regression").alias("regressions"), F.count_if(F.col("kind") == "improvement").alias("improvements"))
    return _changes(both.join(counts, "packet_id", "left").withColumns({"regressions": F.coalesce("regressions", F.lit(0)), "improvements": F.coalesce("improvements", F.lit(0))}))


def slices(moves: DataFrame, packets: DataFrame) -> DataFrame:
    """slice, packets, regressions, improvements, net by edge-case tag (a packet counts under each of its tags, without any under 'none')."""
    tags = packets.select("packet_id", F.explode(F.when(F.size(F.coalesce("edge_cases", F.array())) == 0, F.array(F.lit("none"))).otherwise(F.col("edge_cases"))).alias("slice"))
    out = moves.join(tags, "packet_id").groupBy("slice").agg(F.countDistinct("packet_id").alias("packets"), F.count_if(F.col("kind") == "regression").alias("regressions"), F.count_if(F.col("kind") == "improvement").alias("improvements"))
    return out.withColumn("net", F.col("improvements") - F.col("regressions")).orderBy(F.desc("regressions"), F.desc("improvements"), "slice")


def summary_delta(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: the candidate's summary less the baseline's."""
    names = [n for n in ("accuracy", "correct", "abstention_rate", "latency_mean", "cost_total") if n in baseline.columns and n in candidate.columns]
    b, c = baseline.select(*(F.col(n).alias(f"b_{n}") for n in names)), candidate.select(*(F.col(n).alias(f"c_{n}") for n in names))
    places = {"latency_mean": 3, "cost_total": 6}
    delta = lambda n: F.col(f"c_{n}") - F.col(f"b_{n}")
    return b.join(c).select(*((half_up(delta(n), places[n]) if n in places else delta(n)).alias(n) for n in names))


def injected(scores: DataFrame, blank_only: bool = False, fixed: int = 0) -> DataFrame:
    """``scores`` with the first correct item (by packet, then key; with ``blank_only`` the first whose truth is blank) made wrong, and the first
    ``fixed`` wrong items (by packet, then key) made right; ``mutated`` tells which ('broken', 'fixed').

    Each pick is a top-k over the scores, aggregated before it is shuffled, not a sort of them all.
    """
    order = F.struct("packet_id", "key", "ord")
    blank = F.col("expected_str").isNull() & F.col("expected_num").isNull()
    good = scores.where("correct").where(blank if blank_only else F.lit(True)).agg(F.min(order).alias("_o"))
    rows = scores.join(F.broadcast(good)).withColumn("_broken", F.coalesce(F.col("_o") == order, F.lit(False))).drop("_o")
    if fixed:
        bad = scores.where("NOT correct").orderBy("packet_id", "key", "ord").limit(fixed).select("packet_id", "key", "ord", F.lit(True).alias("_fixed"))
        rows = rows.join(F.broadcast(bad), ["packet_id", "key", "ord"], "left")
    else:
        rows = rows.withColumn("_fixed", F.lit(None).cast("boolean"))
    fix = F.coalesce("_fixed", F.lit(False))
    wrong_num = F.when(F.col("expected_num").isNotNull(), F.col("expected_num") + 1)
    wrong_str = F.when(F.col("expected_str").isNotNull(), F.concat("expected_str", F.lit(" (injected)"))).when(F.col("expected_num").isNull(), F.lit("Injected value"))
    out = rows.withColumns(
        {
            "actual_num": F.when(F.col("_broken"), wrong_num).when(fix, F.col("expected_num")).otherwise(F.col("actual_num")),
            "actual_str": F.when(F.col("_broken"), wrong_str).when(fix, F.col("expected_str")).otherwise(F.col("actual_str")),
            "correct": F.when(F.col("_broken"), False).when(fix, True).otherwise(F.col("correct")),
            "mutated": F.when(F.col("_broken"), "broken").when(fix, "fixed"),
        }
    )
    return out.select(*scores.columns, "mutated")


DRILLS = {"single-field": {}, "blank-fill": {"blank_only": True}, "decoy-gains": {"fixed": 5}}


def drill(baseline: DataFrame, candidate: DataFrame, id: str) -> DataFrame:
    """One row: drill_id, packet_id and key of the broken field, fixed, verdict, caught (the gate regressed) and named (by that very field)."""
    mutated = injected(candidate, **DRILLS[id])
    moves = movements(baseline, mutated.drop("mutated"))
    broken = mutated.where("mutated = 'broken'").select("packet_id", "key")
    n_fixed = mutated.agg(F.count_if(F.col("mutated") == "fixed").alias("fixed"))
    verdict = gate(moves).select("verdict")
    hit = moves.where("kind = 'regression'").join(F.broadcast(broken), ["packet_id", "key"], "left_semi").agg((F.count(F.lit(1)) > 0).alias("named"))
    out = n_fixed.join(verdict).join(hit).join(broken, how="left")
    return out.select(F.lit(id).alias("drill_id"), "packet_id", "key", "fixed", "verdict", (F.col("verdict") == "regressed").alias("caught"), "named")


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group, by a maximum that is aggregated before the shuffle."""
    names = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*names), order).alias("r")).select(*by, "r.*")
