"""The golden matrix, end to end from a directory of texts."""

import json

import pytest
from pyspark.sql import functions as F

from fieldgate.config import UnknownVersion, BadThreshold, Version, version, what_if, Profile, Guidelines
from fieldgate.operators.diff import compare_packets, drill, gate, movements, slices, summary_delta
from fieldgate.operators.rules import low_confidence
from fieldgate.operators.score import calibration
from fieldgate.plans import queries
from fieldgate.plans.lab import comparison, corpus_hash, manifest, metered_cost, public_suite, robustness, run, suite, what_if_changes
from fieldgate.sources.packets import as_packets, corpus_index, document, list_packets, read_documents, read_truth, to_json_rows
from fieldgate.sources.render import rendered

from . import golden

V1, V2, V21 = "v1-regex", "v2-heuristic", "v2.1-no-backfill"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    golden.write(path)
    docs = read_documents(spark, str(path / "packets")).cache()
    truth = read_truth(spark, str(path / "truth.json")).cache()
    packets = as_packets(docs).cache()
    suites = {}
    for id in (V1, V2, V21):
        s = suite(packets, truth, version(id))
        s["runs"] = s["runs"].cache()
        s["scores"] = s["scores"].cache()
        suites[id] = s
    return docs, truth, packets, suites


@pytest.mark.parametrize("id", [V1, V2])
def test_matrix(corpus, id):
    rows = corpus[3][id]["runs"].select("packet_id", "routing.decision", F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("conflicts", lambda c: c["conflict_id"]), ",").alias("c"), F.array_join(F.transform("routing.reasons", lambda r: r["kind"]), ",").alias("r")).collect()
    assert {r["packet_id"]: (r["decision"], r["flags"]) for r in rows} == golden.EXPECTED[id]
    assert {r["packet_id"]: r["c"] for r in rows if r["c"]} == golden.CONFLICTS[id]
    assert {r["packet_id"]: r["r"] for r in rows if r["r"]} == golden.REASONS[id]


def test_totals(corpus):
    tiv = {id: {r["packet_id"]: (r["listed_tiv"], r["computed_tiv"]) for r in corpus[3][id]["runs"].collect()} for id in (V1, V2)}
    assert tiv[V2]["G-3"] == (55_300_000, 40_950_000)
    assert (tiv[V1]["G-6"][1], tiv[V2]["G-6"][1]) == (38_000_000, 52_000_000)
    assert (tiv[V1]["G-7"][1], tiv[V2]["G-7"][1]) == (125_200_000, 128_300_000)
    assert tiv[V2]["G-8"][1] == 112_300_000


def test_regressions_by_identity(corpus):
    s = corpus[3]
    moves = movements(s[V1]["scores"], s[V2]["scores"]).collect()
    lost = {(m["packet_id"], m["key"]): (m["candidate_actual_str"] or m["candidate_actual_num"], m["candidate_confidence"], m["candidate_method"]) for m in moves if m["kind"] == "regression"}
    assert lost == {("G-2", "L2.constructionType"): ("Joisted Masonry", 0.5, "context-backfill"), ("G-2", "L2.yearBuilt"): (2025, 0.5, "context-backfill")}
    assert sum(m["kind"] == "improvement" for m in moves) == 16
    assert gate(movements(s[V1]["scores"], s[V2]["scores"])).first()["verdict"] == "regressed"
    assert gate(movements(s[V2]["scores"], s[V21]["scores"])).first().asDict() == {"regressions": 0, "improvements": 2, "net": 2, "verdict": "clean"}
    assert gate(movements(s[V1]["scores"], s[V1]["scores"])).first()["verdict"] == "clean"


def test_summary_and_calibration(corpus):
    s = corpus[3]
    one = s[V21]["summary"].first()
    assert one["accuracy"] == 1.0 and one["abstention_rate"] == 0.5 and one["cost_is_simulated"]
    assert (one["n_quote"], one["n_decline"], one["n_referred"]) == (2, 2, 4)
    delta = summary_delta(s[V1]["summary"], s[V2]["summary"]).first()
    assert delta["correct"] == 14 and delta["cost_total"] > 0
    bands = {r["band"]: r for r in calibration(s[V21]["scores"]).collect()}
    assert sorted(bands) == [0, 1, 2, 3] and bands[0]["n"] == 0 and bands[0]["accuracy"] is None and bands[3]["accuracy"] == 1.0


def test_slices(corpus):
    moves = movements(corpus[3][V1]["scores"], corpus[3][V2]["scores"])
    rows = [tuple(r) for r in slices(moves, corpus[1]).collect()]
    assert rows[0][:4] == ("MISSING_FIELD", 2, 2, 7) and [r[2] for r in rows[1:]] == [0] * (len(rows) - 1)
    assert [r[3] for r in rows[1:]] == sorted((r[3] for r in rows[1:]), reverse=True)


def test_every_value_has_evidence_or_an_explanation(corpus):
    docs, _, packets, suites = corpus
    texts = {(r["packet_id"], r["doc_id"]): r["text"] for r in docs.collect()}
    for r in suites[V2]["runs"].collect():
        for x in r["listed"]:
            for name in ("address", "buildingValue", "yearBuilt", "constructionType", "zip"):
                f = x[name]
                if f["value"] is None:
                    assert f["method"] in ("explicit-blank", "label-miss", "currency-parse-fail", "year-parse-fail", "csz-parse-fail", "sov-row")
                else:
                    e = f["evidence"]
                    snippet = texts[r["packet_id"], e["doc"]][e["start"] : e["end"]]
                    assert name not in ("address", "yearBuilt") or snippet == str(f["value"])
                assert f["method"] != "context-backfill" or f["confidence"] == 0.5
        e = r["insuredName"]["evidence"]
        assert texts[r["packet_id"], "acord"][e["start"] : e["end"]] == r["insuredName"]["value"]


def test_sources(corpus, spark):
    docs, truth, packets, suites = corpus
    assert [r[0] for r in list_packets(docs).collect()] == [f"G-{i}" for i in range(1, 9)]
    assert "\r" not in document(docs, "G-1", "acord").first()["text"]
    index = {r["packet_id"]: r for r in corpus_index(docs).collect()}
    assert [d["doc_id"] for d in index["G-6"]["documents"]] == ["acord", "sov", "loss_run", "endorsement", "email"]
    assert truth.count() == 8
    assert json.loads(to_json_rows(truth.select("packet_id").orderBy("packet_id")).first()["json"]) == {"packet_id": "G-1"}


def test_drills(corpus):
    s = corpus[3]
    for id in ("single-field", "blank-fill", "decoy-gains"):
        r = drill(s[V1]["scores"], s[V1]["scores"], id).first()
        assert r["verdict"] == "regressed" and r["caught"] and r["named"]
        assert r["fixed"] == (5 if id == "decoy-gains" else 0)
    assert drill(s[V1]["scores"], s[V1]["scores"], "blank-fill").first()["key"] == "L2.constructionType"


def test_what_if(corpus):
    moved = {r["packet_id"]: (r["baseline_decision"], r["decision"]) for r in what_if_changes(corpus[3][V2]["runs"], version(V2), tivCeiling=40_000_000).collect()}
    assert moved == {"G-2": ("quote", "decline"), "G-3": ("referred", "decline")}
    for bad in ({"tivCeiling": 5}, {"other": 3}, {"maxMonthsAhead": float("nan")}, {"lossRatioCeilingPct": "x"}):
        with pytest.raises(BadThreshold):
            what_if(version(V2), **bad)
    with pytest.raises(UnknownVersion):
        version("v9")


def test_robustness_and_manifest(corpus):
    docs, truth, packets, s = corpus
    rows = {r["profile"]: r for r in robustness(packets, truth, version(V1), ["ocr-heavy", "pdf-layout"]).collect()}
    assert rows["pdf-layout"]["delta_vs_clean"] == 0 and rows["ocr-heavy"]["delta_vs_clean"] <= 0
    h = corpus_hash(docs).first()[0]
    assert h == corpus_hash(docs.repartition(3)).first()[0] != corpus_hash(docs.where("packet_id <> 'G-1'")).first()[0]
    m = manifest(version(V2), s[V2]["runs"], s[V2]["totals"], docs).collect()
    assert len(m) == 8 and {r["corpus_hash"] for r in m} == {h}
    assert version(V1).fingerprint() != version(V2).fingerprint()


def test_manifest_covers_documents_and_truth(spark, monkeypatch):
    """The registered manifest's hash changes with any document of a packet and with its truth."""
    some = rendered(spark, "/root/testdata/sf0.001").limit(40)
    r = spark.createDataFrame(some.collect(), some.schema)
    runs = spark.createDataFrame([("P", ("quote", False))], "packet_id string, routing struct<decision:string,abstained:boolean>")
    monkeypatch.setattr(queries, "runs", lambda *a: runs)
    monkeypatch.setattr(queries, "scores", lambda *a: None)
    monkeypatch.setattr(queries, "run_totals", lambda _: spark.createDataFrame([("P", 1, 1)], "packet_id string, correct int, total int"))

    def hash_of(df):
        monkeypatch.setattr(queries, "packets", lambda *a: df)
        return queries.version_manifest(spark, "").first()["corpus_hash"]

    scalar = next(c for c, t in r.dtypes if c.startswith("t_") and t == "string")
    hashes = [hash_of(r)]
    for c in ("acord", "sov", "loss_run", "endorsement", "email", scalar):
        first = r.where(F.col(c).isNotNull()).agg(F.min("packet_id")).first()[0]
        assert first is not None
        hashes.append(hash_of(r.withColumn(c, F.when(F.col("packet_id") == first, F.concat(c, F.lit("x"))).otherwise(F.col(c)))))
    assert len(set(hashes)) == 7 and hash_of(r.repartition(3)) == hashes[0]


def test_projections(corpus, spark):
    s = corpus[3]
    assert public_suite(s[V2]["runs"], s[V2]["totals"]).count() == 8
    rows = {r["packet_id"]: r for r in compare_packets(s[V1]["runs"], s[V2]["runs"], movements(s[V1]["scores"], s[V2]["scores"])).collect()}
    assert rows["G-6"]["routing_changed"] and rows["G-6"]["flags_added"] == ["GL-001"]
    assert rows["G-2"]["flags_removed"] == ["GL-001", "GL-002"] and rows["G-2"]["net"] == 0
    assert {r["key"] for r in low_confidence(s[V2]["runs"]).collect()} == {"L2.constructionType", "L2.yearBuilt"}
    usage = spark.createDataFrame([("default", 1_000_000, 1_000_000)], "model string, input_tokens bigint, output_tokens bigint")
    assert metered_cost(usage).first()["cost_usd"] == 0.75
    with pytest.raises(Exception, match="no rate for model"):
        metered_cost(usage.withColumn("model", F.lit("other"))).collect()


def test_comparison(corpus):
    c = comparison(corpus[2], corpus[1], version(V2), version(V21))
    assert c["gate"].first()["verdict"] == "clean" and c["movements"].count() == 2 and c["packets"].count() == 8
    assert c["slices"].first()["slice"] == "MISSING_FIELD" and c["delta"].first()["correct"] == 2


def test_empty_scope(spark):
    none = spark.createDataFrame([("p", None, None, None, None, None)], "packet_id string, acord string, sov string, loss_run string, endorsement string, email string")
    r = run(none, Version("x", Profile("x"), Guidelines())).first()
    assert r["insuredName"]["method"] == "doc-missing" and r["routing"]["decision"] == "referred" and r["routing"]["confidence"] == 0.1
    assert r["lossCount"]["value"] == 0 and r["lossRunTotalIncurred"]["value"] is None and r["computed_tiv"] is None
    assert run(none.where("false"), Version("x", Profile("x"), Guidelines())).count() == 0
