"""Versions over a corpus as one plan each: runs, suites, comparisons, what-ifs, robustness and manifests."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DOCUMENTS, METERED_RATES, SIMULATED_RATES, Version, what_if
from ..functions.noise import perturb_text
from ..functions.scalars import half_up, tokens
from ..operators import batch
from ..operators.diff import DRILLS, compare_packets, drill, gate, movements, slices, summary_delta
from ..operators.model_reader import extract_from_model
from ..operators.reconcile import resolve
from ..operators.reviews import history, latest_by_packet
from ..operators.rules import apply_rules
from ..operators.score import calibration, run_totals, score, summarize


def simulated_cost(runs: DataFrame) -> DataFrame:
    """Adds input_tokens, output_tokens, cost_usd and simulated, from characters, passes and the size of what was extracted."""
    written = F.length(F.to_json(F.struct(*(c for c in ("insuredName", "receivedDate", "requestedEffectiveDate", "statedTiv", "locations", "losses", "amendments") if c in runs.columns))))
    rows = runs.withColumns({"input_tokens": tokens(F.col("input_chars")) * F.greatest(F.lit(1), F.col("passes")), "output_tokens": tokens(written)})
    usd = F.col("input_tokens") / 1000 * SIMULATED_RATES["input_per_1k"] + F.col("output_tokens") / 1000 * SIMULATED_RATES["output_per_1k"]
    return rows.withColumns({"cost_usd": half_up(usd, 6), "simulated": F.lit(True)})


def metered_cost(usage: DataFrame, rates: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds cost_usd and simulated to rows with model, input_tokens and output_tokens; an unknown model raises an error."""
    rates = METERED_RATES if rates is None else rates
    unknown = F.raise_error(F.concat(F.lit("no rate for model "), F.coalesce("model", F.lit("null")))).cast("double")
    price = lambda n: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for m, r in rates.items() for x in (m, float(r[n])))), F.col("model")), unknown)
    usd = F.col("input_tokens") / 1e6 * price("input_per_1m") + F.col("output_tokens") / 1e6 * price("output_per_1m")
    return usage.withColumns({"cost_usd": half_up(usd, 6), "simulated": F.lit(False)})


def run(packets: DataFrame, version: Version, as_of_year: int = 2026, cache: DataFrame | None = None, columns: str | None = None) -> DataFrame:
    """Extraction, reconciliation, rules and routing of every packet, without a shuffle. ``columns``: those wanted, as DDL (default: all)."""
    if version.profile.engine != "llm":
        return batch.evaluate(packets, [version], columns, as_of_year)
    if cache is None:
        raise ValueError("a model-backed version needs a response cache")
    return apply_rules(resolve(extract_from_model(packets, version, cache), version), version)


def run_all(packets: DataFrame, versions: list[Version], as_of_year: int = 2026) -> DataFrame:
    return reduce(DataFrame.unionByName, (run(packets, v, as_of_year) for v in versions))


def suite(packets: DataFrame, truth: DataFrame, version: Version, as_of_year: int = 2026) -> dict[str, DataFrame]:
    """runs, scores, totals, summary and calibration of a version."""
    runs = simulated_cost(run(packets, version, as_of_year))
    scores = score(runs, truth)
    totals = run_totals(scores)
    return {"runs": runs, "scores": scores, "totals": totals, "summary": summarize(runs, totals), "calibration": calibration(scores)}


def comparison(packets: DataFrame, truth: DataFrame, baseline: Version, candidate: Version, as_of_year: int = 2026) -> dict[str, DataFrame]:
    """movements, gate, packets, slices and delta of two versions. Their runs and scores are kept in the session, as each is read several times."""
    sides = []
    for v in (baseline, candidate):
        runs = simulated_cost(run(packets, v, as_of_year)).persist()
        scores = score(runs, truth).persist()
        sides.append((runs, scores, summarize(runs, run_totals(scores))))
    (base_runs, base_scores, base_summary), (runs, scores, summary) = sides
    moves = movements(base_scores, scores)
    return {"movements": moves, "gate": gate(moves), "packets": compare_packets(base_runs, runs, moves), "slices": slices(moves, truth), "delta": summary_delta(base_summary, summary)}


def public_suite(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """What a list of a suite shows of each packet, without the payload."""
    return runs.select("version_id", "packet_id", F.col("routing.decision").alias("decision"), F.col("routing.abstained").alias("abstained"), F.size("flags").alias("flag_count"), F.size("conflicts").alias("conflict_count"), F.col("computed_tiv").alias("computedTiv"), F.size("locations").alias("location_count")).join(totals, ["version_id", "packet_id"])


def suite_list(runs: DataFrame, totals: DataFrame, reviews: DataFrame, order: str = "recordedAt") -> DataFrame:
    """:func:`public_suite` with the latest review of each packet, null where there is none."""
    last = latest_by_packet(reviews, order).select(F.col("versionId").alias("version_id"), F.col("packetId").alias("packet_id"), F.col("decision").alias("review_decision"), F.col("reviewer").alias("reviewer"))
    return public_suite(runs, totals).join(last, ["version_id", "packet_id"], "left")


def known_packet(rows: DataFrame, packet_id: str) -> DataFrame:
    """The rows of a packet; ValueError if there are none."""
    found = rows.where(F.col("packet_id") == packet_id)
    if found.isEmpty():
        raise ValueError(f"no packet {packet_id}")
    return found


def run_view(packet_id: str, runs: DataFrame, scores: DataFrame, truth: DataFrame, reviews: DataFrame, order: str = "recordedAt") -> dict[str, DataFrame]:
    """run, score, truth, review (the latest of each version) and history of one packet. An unknown packet raises ValueError."""
    own = reviews.where(F.col("packetId") == packet_id)
    return {
        "run": known_packet(runs, packet_id),
        "score": scores.where(F.col("packet_id") == packet_id).orderBy("version_id", "ord"),
        "truth": truth.where(F.col("packet_id") == packet_id),
        "review": latest_by_packet(own, order),
        "history": history(own, packet_id, order),
    }


def meta(spark: SparkSession, versions: list[Version]) -> DataFrame:
    """A row per version: its id, engine, fingerprint, guidelines and profile as JSON."""
    rows = [(v.id, v.profile.engine, v.fingerprint(), json.dumps(asdict(v.guidelines), sort_keys=True, default=str), json.dumps(asdict(v.profile), sort_keys=True, default=str)) for v in versions]
    return spark.createDataFrame(rows, "version_id string, engine string, fingerprint string, guidelines string, profile string")


def what_if_changes(runs: DataFrame, version: Version, **thresholds: float) -> DataFrame:
    """packet_id, both decisions and flags of packets that other thresholds move. ``runs`` of the version are read once (keep them with persist()
    if they are not a table): thresholds touch neither extraction nor reconciliation."""
    other = what_if(version, **thresholds)
    rules = ("checks", "conflicts", "routing", "flags")
    base = runs.withColumns({"base_routing": F.struct("routing.decision", "routing.abstained"), "base_flags": F.col("flags")}).drop(*rules)
    out = apply_rules(base, other).select("packet_id", F.col("base_routing.decision").alias("baseline_decision"), F.col("routing.decision").alias("decision"), F.col("base_routing.abstained").alias("_a"), F.col("routing.abstained").alias("abstained"), F.col("base_flags").alias("baseline_flags"), "flags", "computed_tiv")
    moved = (F.col("baseline_decision") != F.col("decision")) | (F.col("_a") != F.col("abstained")) | (F.col("baseline_flags") != F.col("flags"))
    return out.where(moved).drop("_a")


def what_if_moves(packets: DataFrame, version: Version, as_of_year: int = 2026, **thresholds: float) -> DataFrame:
    """:func:`what_if_changes` from packets, which are read once for both sides."""
    side = "struct<routing:struct<decision:string,abstained:boolean>,flags:array<string>,computed_tiv:bigint>"
    b, c = "baseline_run", "candidate_run"
    rows = batch.compare(packets, [(version, what_if(version, **thresholds))], f"{b} {side}, {c} {side}", as_of_year)
    return rows.where(f"{b}.routing <> {c}.routing OR {b}.flags <> {c}.flags").select("packet_id", F.col(f"{b}.routing.decision").alias("baseline_decision"), F.col(f"{c}.routing.decision").alias("decision"), F.col(f"{c}.routing.abstained").alias("abstained"), F.col(f"{b}.flags").alias("baseline_flags"), F.col(f"{c}.flags").alias("flags"), F.col(f"{c}.computed_tiv").alias("computed_tiv"))


def drill_packets(packets: DataFrame, baseline: Version, candidate: Version, id: str, as_of_year: int = 2026) -> DataFrame:
    """:func:`fieldgate.operators.diff.drill` of two versions of packets that have the column ``truth``.

    Whom a drill may break and fix is found by one pass, whose few rows are collected; the drill itself is run over these packets only, and all others
    count for the verdict by their regressions as they are.
    """
    how = DRILLS[id]
    found = batch.candidates(packets, baseline, candidate, how.get("blank_only", False), how.get("fixed", 0), as_of_year).collect()
    good = min((r["good"] for r in found if r["good"] is not None), default=None)
    touched = sorted({*sorted(p for r in found for p in r["bad"])[: how.get("fixed", 0)], *([good] if good is not None else [])})
    some = packets.where(F.col("packet_id").isin(touched))
    versions = list({v.id: v for v in (baseline, candidate)}.values())
    scores = batch.evaluate(some, versions, f"items array<{batch.ITEM}>", as_of_year).select("version_id", "packet_id", F.inline("items")).persist()
    was, now = (scores.where(F.col("version_id") == v.id) for v in (baseline, candidate))
    others = gate(movements(was, now)).select((F.lit(sum(r["regressions"] for r in found)) - F.col("regressions") > 0).alias("_others"))
    lost = (F.col("verdict") == "regressed") | F.col("_others")
    return drill(was, now, id).join(others).withColumns({"verdict": F.when(lost, "regressed").otherwise("clean"), "caught": lost}).drop("_others")


def robustness(packets: DataFrame, truth: DataFrame | None, version: Version, profiles: list[str], reindex: bool = False, as_of_year: int = 2026) -> DataFrame:
    """profile, accuracy, delta_vs_clean, decisions_moved. Without ``reindex`` record lines stay as they were and only the application's labels,
    amendments' dates and prose are read from the noisy text; with it everything is. Without ``truth`` packets have it as the column ``truth``."""
    kinds = list(DOCUMENTS) if reindex else ["acord", "email"]
    rows = packets if truth is None else batch.with_truth(packets, truth)
    rows = rows.withColumns({f"{d}@{p}": perturb_text(F.col(d), p, F.col("packet_id"), F.lit(d)) for p in profiles for d in kinds})
    sums = batch.variants(rows, version, profiles, kinds, as_of_year).groupBy("profile").agg((F.sum("correct") / F.sum("total")).alias("accuracy"), F.sum("moved").alias("moved"))
    one = sums.agg(F.collect_list(F.struct("profile", "accuracy", "moved")).alias("g")).select("g", F.explode(F.array(*(F.lit(p) for p in profiles))).alias("profile"))
    of = lambda p: F.get(F.filter("g", lambda x: x["profile"] == p), F.lit(0))
    own, clean = of(F.col("profile")), of(F.lit(""))
    return one.select("profile", own["accuracy"].alias("accuracy"), (own["accuracy"] - clean["accuracy"]).alias("delta_vs_clean"), F.coalesce(own["moved"], F.lit(0)).alias("decisions_moved"))


def corpus_hash(documents: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row, corpus_hash: sha256 over the hashes of packets, each over those of its documents by doc_id
    and, with ``truth``, of its truth row, all columns by name. Two levels, so that one task gets fixed-size hashes of packets, by blocks of 16 bits of them, and never texts."""
    leaf = documents.select("packet_id", F.sha2(F.concat_ws("\x1f", "packet_id", "doc_id", "text"), 256).alias("h"))
    if truth is not None:
        label = F.to_json(F.struct(*sorted(truth.columns)), {"ignoreNullFields": "false"})
        leaf = leaf.unionByName(truth.select("packet_id", F.sha2(F.concat_ws("\x1e", F.lit("truth"), "packet_id", label), 256).alias("h")))
    packet = leaf.groupBy("packet_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    block = packet.groupBy(F.substring("h", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return block.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("corpus_hash"))


def manifest(version: Version, runs: DataFrame, totals: DataFrame, documents: DataFrame, truth: DataFrame | None = None, created_at: str | None = None) -> DataFrame:
    """A row per packet outcome of the run, under the version's fingerprint and the corpus hash; ``created_at`` is the caller's, so that equal runs have equal manifests."""
    outcome = runs.select("packet_id", F.col("routing.decision").alias("decision"), F.col("routing.abstained").alias("abstained")).join(totals.select("packet_id", "correct", "total"), "packet_id")
    g = version.guidelines
    return outcome.join(F.broadcast(corpus_hash(documents, truth))).select(F.lit(version.id).alias("version_id"), F.lit(version.fingerprint()).alias("profile_hash"), "corpus_hash", F.lit(g.addressMatching).alias("address_matching"), F.lit(created_at).cast("string").alias("created_at"), F.lit(g.tivCeiling).alias("tiv_ceiling"), F.lit(g.lossRatioCeilingPct).alias("loss_ratio_ceiling_pct"), F.lit(g.maxMonthsAhead).alias("max_months_ahead"), "packet_id", "decision", "abstained", "correct", "total")
