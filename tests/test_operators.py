"""Reconciliation order, row matching, reviews, model responses and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from fieldgate.config import LOCATION_FIELDS, REQUIRED_LOCATION_FIELDS, REQUIRED_SCALARS, SCALARS, SOFT_LOCATION_FIELDS, SOFT_SCALARS, TEXT_FIELDS, Guidelines, Profile, Version, version
from fieldgate.functions.text import line_index
from fieldgate.operators.diff import injected
from fieldgate.operators.model_reader import request_key
from fieldgate.operators.reviews import BadReview, append_review, clear_reviews, history, latest_by_packet, load_reviews, review_queue, validate
from fieldgate.operators.score import assign_rows, score
from fieldgate.plans.lab import meta, run, run_view, suite_list
from fieldgate.sources.packets import read_cache, write_cache
from fieldgate.streaming.reviews import latest_stream, stream_reviews

SCHEMA = "packet_id string, acord string, sov string, loss_run string, endorsement string, email string"


def one(spark, sov, endorsement=None, v=None):
    packets = spark.createDataFrame([("p", None, sov, None, endorsement, None)], SCHEMA)
    return run(packets, v or Version("x", Profile("x"), Guidelines())).first()


def test_duplicates_are_a_star_not_a_closure(spark):
    row = "LOC | L{} | {} | Salem, OR 97301 | Building: $1 | Contents: $1 | BI: $1"
    sov = "\n".join(row.format(i, a) for i, a in enumerate(["1420 Kestrel Avenue", "88 Other Street", "1420 Kestrel Ave", "1420 Kestrl Avenue"]))
    r = one(spark, sov)
    assert [(d["keep_idx"], d["dup_idx"], d["basis"]) for d in r["dup_members"]] == [(0, 2, "fuzzy"), (0, 3, "fuzzy")]  # the group's basis: its last member's
    assert r["removed_notes"] == [f"Removed L{i} ({a}) as a repeat of L0 (1420 Kestrel Avenue), matched on fuzzy." for i, a in ((2, "1420 Kestrel Ave"), (3, "1420 Kestrl Avenue"))]
    assert r["computed_tiv"] == 6 and r["listed_tiv"] == 12
    assert [x["loc_id"] for x in r["locations"]] == ["L0", "L1"]


def test_amendments_apply_in_order(spark):
    sov = "LOC | A | 1 Elm Ave | Salem, OR 97301 | Building: $100 | Contents: $1 | BI: $1\nLOC | B | 1 Elm Avenue | Salem, OR 97301 | Building: $100 | Contents: $1 | BI: $1"
    change = "Date: 2026-01-02\nENDORSE | A | x | Building: $100 -> $200\nENDORSE | B | 1 Elm Ave | Building: $200 -> $300\nENDORSE | Z | nowhere | BI: $1 -> $2\nENDORSE | A | x | Roof: $1 -> $2\nENDORSE | A | x | Contents: $1 -> TBD"
    r = one(spark, sov, change)
    assert [(a["loc_id"], a["from_value"], a["to_value"]) for a in r["applied"]] == [("A", 100, 200), ("A", 200, 300)]
    assert r["unmatched"] == ["end-3"] and r["computed_tiv"] == 302 and r["locations"][0]["buildingValue"]["method"] == "endorsement"


def test_null_taxonomy(spark):
    r = one(spark, "LOC | | 1 Elm | nowhere | Building: x | BI:")
    x = r["listed"][0]
    got = {n: (x[n]["method"], x[n]["confidence"]) for n in LOCATION_FIELDS}
    assert x["loc_id"] == "L1" and got["city"] == ("csz-parse-fail", 0.2) and got["buildingValue"] == ("currency-parse-fail", 0.25)
    assert got["contentsValue"] == ("label-miss", 0.2) and got["biValue"] == ("explicit-blank", 0.9)
    assert one(spark, "LOC | a")["listed"][0]["zip"]["method"] == "sov-row"


@pytest.mark.parametrize("truth, produced, taken", [("AB", "ABA", [0, 1]), ("AB", "BA", [1, 0]), ("AB", "XB", [0, 1]), ("AB", "A", [0, -1]), ("AB", "", [-1, -1]), ("", "A", [])])
def test_row_matching(spark, truth, produced, taken):
    rows = spark.sql(f"SELECT array({', '.join(f'named_struct(\"address\", \"{c}\")' for c in truth)}) AS t, array({', '.join(f'named_struct(\"address\", named_struct(\"value\", \"{c}\"))' for c in produced)}) AS p")
    if not truth:
        rows = rows.withColumn("t", F.array().cast("array<struct<address:string>>"))
    if not produced:
        rows = rows.withColumn("p", F.array().cast("array<struct<address:struct<value:string>>>"))
    assert rows.select(assign_rows(F.col("t"), F.col("p"))).first()[0] == taken


def test_score_keys_and_white_space(spark):
    """Truth rows without a produced row are numbered from 1; any white space around a text is ignored; decoys are fixed in the order of keys."""
    field = lambda v, kind: f"named_struct('value', cast({v} AS {kind}), 'confidence', 0.9D, 'method', 'm')"
    kind = lambda n: "string" if n in TEXT_FIELDS else "bigint"
    scalars = ", ".join(f"{field(chr(39) + 'Acme' + chr(39) if n == 'insuredName' else 'NULL', kind(n))} AS {n}" for n in SCALARS)
    row = ", ".join(f"'{n}', {field('NULL', kind(n))}" for n in LOCATION_FIELDS)
    runs = spark.sql(f"SELECT 'v' AS version_id, 'p' AS packet_id, {scalars}, filter(array(named_struct('loc_id', 'L1', {row})), x -> false) AS locations")
    plain = ", ".join(f"'{n}', cast({chr(39) + 'x' + chr(39) if n in TEXT_FIELDS else 1} AS {kind(n)})" for n in LOCATION_FIELDS)
    own = ", ".join(f"cast({chr(39) + chr(92) + 't Acme' + chr(92) + 'n' + chr(39) if n == 'insuredName' else 'NULL'} AS {kind(n)}) AS {n}" for n in SCALARS)
    truth = spark.sql(f"SELECT 'p' AS packet_id, {own}, array(named_struct({plain}), named_struct({plain})) AS locations")
    scores = score(runs, truth).cache()
    keys = [r["key"] for r in scores.orderBy("ord").collect()]
    assert [k for k in keys if k.startswith("expected#")] == [f"expected#{i}.{n}" for i in (1, 2) for n in LOCATION_FIELDS]
    assert scores.where("key = 'insuredName'").first()["correct"]
    wrong = sorted(r["key"] for r in scores.where("NOT correct").collect())
    assert sorted(r["key"] for r in injected(scores, fixed=5).where("mutated = 'fixed'").collect()) == wrong[:5]


def test_completeness_evidence(spark):
    """Scalars that were read, then each row's required and supporting cells in order, twelve at most."""
    sov = "\n".join(f"LOC | L{i} | {i} Elm Ave | Salem, OR 97301 | Building: $1 | Contents: $2 | BI: $3 | Construction: Frame | Year: 1990" for i in (1, 2, 3))
    r = one(spark, sov)
    check = next(c for c in r["checks"] if c["check_id"] == "GL-002")
    cells = [x[n]["evidence"] for x in r["locations"] for n in (*REQUIRED_LOCATION_FIELDS, *SOFT_LOCATION_FIELDS) if x[n]["evidence"]]
    scalars = [r[n]["evidence"] for n in (*REQUIRED_SCALARS, *SOFT_SCALARS) if r[n]["evidence"]]
    assert check["evidence"] == (scalars + cells)[:12] and len(cells) >= 12


def test_views(spark):
    runs = run(spark.createDataFrame([(k, "x", None, None, None, None) for k in "pq"], SCHEMA), version("v1-regex")).cache()
    id = version("v1-regex").id
    totals = spark.createDataFrame([(id, "p", 1, 2, 0.5), (id, "q", 1, 2, 0.5)], "version_id string, packet_id string, correct bigint, total bigint, accuracy double")
    log = spark.createDataFrame([("p", id, "approve", "a", "", 1), ("p", id, "decline", "b", "", 2), ("z", id, "approve", "a", "", 3)], "packetId string, versionId string, decision string, reviewer string, note string, seq int")
    got = {r["packet_id"]: r["review_decision"] for r in suite_list(runs, totals, log, "seq").collect()}
    assert got == {"p": "decline", "q": None}
    scores = spark.createDataFrame([(id, "p", 1, "b"), (id, "p", 0, "a"), (id, "q", 0, "a")], "version_id string, packet_id string, ord int, key string")
    view = run_view("p", runs, scores, totals, log, "seq")
    assert [r["key"] for r in view["score"].collect()] == ["a", "b"] and view["review"].first()["decision"] == "decline" and view["history"].count() == 2 and view["run"].count() == view["truth"].count() == 1
    with pytest.raises(ValueError, match="no packet"):
        run_view("nowhere", runs, scores, totals, log, "seq")
    rows = meta(spark, [version("v1-regex"), version("v2-heuristic")]).collect()
    assert [r["version_id"] for r in rows] == ["v1-regex", "v2-heuristic"] and all("tivCeiling" in json.loads(r["guidelines"]) for r in rows)


def test_line_index(spark):
    docs = spark.createDataFrame([(1, "a\r\nbb\n\nc"), (1, ""), (2, None), (3, "x\n")], "doc_id long, text string")
    got = sorted(tuple(r) for r in line_index(docs).collect())
    assert got == [(1, 1, 0, 0, ""), (1, 1, 0, 1, "a"), (1, 2, 2, 4, "bb"), (1, 3, 5, 5, ""), (1, 4, 6, 7, "c"), (3, 1, 0, 1, "x"), (3, 2, 2, 2, "")]


def test_reviews(spark, tmp_path):
    log = str(tmp_path / "log")
    assert load_reviews(spark, log).count() == 0
    for decision, note in (("approve", None), ("needs-info", "why"), ("decline", "x" * 3000)):
        append_review(spark, log, packetId="p", versionId="v", decision=decision, note=note, reviewer=" ")
    rows = load_reviews(spark, log)
    assert latest_by_packet(rows).first()["decision"] == "decline" and [r["decision"] for r in history(rows, "p").collect()] == ["approve", "needs-info", "decline"]
    assert {r["reviewer"] for r in rows.collect()} == {"unattributed"} and max(len(r["note"]) for r in rows.collect()) == 2000
    for bad in ({"packetId": "", "versionId": "v", "decision": "approve"}, {"packetId": "p", "versionId": "v", "decision": "maybe"}, {"packetId": "p", "versionId": "v", "decision": "needs-info"}):
        with pytest.raises(BadReview):
            validate(**bad)
    query = latest_stream(stream_reviews(spark, log)).writeStream.outputMode("complete").format("memory").queryName("latest_reviews").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["decision"] for r in spark.table("latest_reviews").collect()] == ["decline"]
    clear_reviews(spark, log)
    assert load_reviews(spark, log).count() == 0


def test_model_responses(spark, tmp_path):
    packets = spark.createDataFrame([("p", "Insured: Acme", "row 5", None, None, None)], SCHEMA)
    v = version("v3-llm")
    answer = {"insuredName": {"value": "Acme", "quote": "Insured: Acme"}, "receivedDate": {"value": None, "quote": None}, "statedTiv": {"value": "$1,200", "quote": "not there"}, "locations": [{"address": {"value": "row 5", "quote": "row 5", "confidence": 2.0}}], "losses": []}
    key = packets.select(request_key(v)).first()[0]
    path = str(tmp_path / "cache")
    assert read_cache(spark, path).count() == 0
    write_cache(spark.createDataFrame([(key, json.dumps(answer), 10, 5, "default")], "key string, content string, input_tokens bigint, output_tokens bigint, model string"), path)
    r = run(packets, v, cache=read_cache(spark, path)).first()
    assert (r["insuredName"]["value"], r["insuredName"]["confidence"], r["insuredName"]["evidence"]["doc"]) == ("Acme", 0.85, "acord")
    assert r["receivedDate"]["method"] == "llm-miss" and (r["statedTiv"]["value"], r["statedTiv"]["confidence"], r["statedTiv"]["evidence"]) == (1200, 0.45, None)
    assert r["listed"][0]["loc_id"] == "L1" and r["listed"][0]["address"]["confidence"] == 1.0
    with pytest.raises(Exception, match="no cached response"):
        run(packets.withColumn("acord", F.lit("other")), v, cache=read_cache(spark, path)).collect()
    with pytest.raises(ValueError):
        run(packets, v)


def test_queue_has_no_truth(spark):
    runs = run(spark.createDataFrame([("p", "x", None, None, None, None)], SCHEMA), version("v1-regex")).cache()
    queue = review_queue(runs)
    assert not {"correct", "accuracy", "expected_str"} & set(queue.columns) and queue.first()["reasons"][0]["kind"] == "NOT_READABLE"
