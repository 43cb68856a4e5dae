"""Unit tables of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldgate.functions import scalars as S
from fieldgate.functions import text as X
from fieldgate.functions.noise import UnknownNoise, ocr, perturb_text, uniforms


def values(spark, inputs, function, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("x"))).collect()]


STRICT = {"$12,400,000": 12_400_000, "$750,000": 750_000, "$0": 0, " $1,000 ": 1000, "\t$5\n": 5}
LOOSE = STRICT | {"16700000": 16_700_000, "$3.1M": 3_100_000, "750K": 750_000, "$1.25B": 1_250_000_000, "$ 2,000": 2000, "3.1m": 3_100_000, "$1.005M": 1_005_000, "12.5": 13, "12,400,000": 12_400_000}


def test_currency(spark):
    bad = ["TBD", "see attached", "$1,2345", "12,400,000 USD", "", None]
    every = [*LOOSE, *bad]
    assert values(spark, every, S.strict_currency) == [STRICT.get(x) for x in every]
    assert values(spark, every, S.loose_currency) == [LOOSE.get(x) for x in every]
    assert values(spark, ["$1,20,000", "$12.50"], S.strict_currency) == [None, None]


def test_money_text(spark):
    numbers = [1234567.0, -5.0, 0.5, None, float("nan"), float("inf")]
    assert values(spark, numbers, S.format_usd, "double") == ["$1,234,567", "-$5", "$1", "--", "--", "--"]
    assert values(spark, [1.25e9, 12.4e6, 770e3, 12.0, -2e6, None], S.format_usd_compact, "double") == ["$1.25B", "$12.4M", "$770.0K", "$12", "-$2.0M", "--"]
    assert values(spark, ["$1,200", " ", "abc", "3.5", None], S.model_number) == [1200.0, None, None, 3.5, None]
    assert values(spark, [-2.5, 2.5, 1.4], S.half_up, "double") == [-2.0, 3.0, 1.0]
    assert values(spark, [0.123, 0.5], S.percent, "double") == ["12.3%", "50.0%"]


def test_dates(spark):
    good = ["2026-03-01", " 2026-03-01 ", "2028-02-29"]
    bad = ["2026-02-30", "2025-02-29", "2026-13-01", "2026-00-10", "2026-01-00", "03/01/2026", "2026-3-1", "", None]
    assert [str(x) for x in values(spark, good, S.iso_date)] == ["2026-03-01", "2026-03-01", "2028-02-29"]
    assert values(spark, bad, S.iso_date) == [None] * len(bad)
    d = datetime.date
    pairs = [(d(2026, 1, 1), d(2027, 1, 1)), (d(2026, 1, 15), d(2027, 2, 15)), (d(2026, 2, 10), d(2027, 3, 1)), (d(2026, 2, 28), d(2026, 3, 31))]
    got = [r[0] for r in spark.createDataFrame(pairs, "a date, b date").select(S.months_between(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 12 and got[1] == 13 and got[2] > 12 and got[3] == pytest.approx(1 + 3 / 30.44)


def test_addresses(spark):
    table = {"1420 Kestrel Ave": "1420 KESTREL AVENUE", "88 N Main St": "88 NORTH MAIN STREET", "9 Elm Rd, Suite 100": "9 ELM ROAD", "9 Elm Rd #3": "9 ELM ROAD", "  ": "", None: ""}
    assert values(spark, list(table), S.normalize_address) == list(table.values())
    assert values(spark, ["14 Spindle Court", "1 N St", "12 Long Longer Rd"], S.street_token) == ["SPINDLE", None, "LONGER"]
    rows = spark.createDataFrame(
        [("1 Elm Ave", "1", "1 elm ave ", "1"), ("1 Elm Ave", "1", "1 Elm Avenue", "1"), ("1420 Kestrel Avenue", "1", "1420 Kestrl Avenue", "1"), ("1420 Kestrel Avenue", "1", "1420 Kestrl Avenue", "2"), ("", "1", "", "1"), ("1 Elm Ave", None, "1 Elm Avenue", None), ("1420 Kestrel Avenue", None, "1420 Kestrl Avenue", None)],
        "a string, za string, b string, zb string",
    )
    match = [r[0]["basis"] for r in rows.select(S.match_addresses(F.col("a"), F.col("za"), F.col("b"), F.col("zb"), True)).collect()]
    assert match == ["exact-raw", "exact-normalized", "fuzzy", "none", "none", "exact-normalized", "none"]
    assert [r[0]["match"] for r in rows.select(S.match_addresses(F.col("a"), F.col("za"), F.col("b"), F.col("zb"))).collect()] == [True] + [False] * 6
    assert values(spark, ["x"], lambda c: S.similarity(F.lit("kitten"), F.lit("sitting"))) == [pytest.approx(1 - 3 / 7)]


def test_text(spark):
    text = "one\nLOC | a | Building: $5\n  LOC | b | building : \nNote: x"
    r = spark.createDataFrame([(text,)], "t string").select(X.records(F.col("t"), "LOC |").alias("r"), X.line_at(F.col("t"), F.lit(5)).alias("l"), X.first_match(F.col("t"), "Note: (.)").alias("m"), X.quote_span([("d", F.col("t"))], F.lit("Building")).alias("q")).first()
    assert [(x["line_no"], text[x["start"] : x["end"]]) for x in r["r"]] == [(2, "LOC | a | Building: $5"), (3, "  LOC | b | building : ")]
    assert r["l"] == 2 and (r["m"]["value"], text[r["m"]["start"] : r["m"]["end"]]) == ("x", "x") and text[r["q"]["start"] : r["q"]["end"]] == "Building"
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(X.records(F.col("t"), "LOC |")).alias("r")).select(X.labelled_cell(X.cells(F.col("r")), ["Bldg", "Building"]).alias("h")).collect()
    assert [(h["h"]["raw"], h["h"]["blank"], h["h"]["label"]) for h in rows] == [("$5", False, "Building"), ("", True, "Building")]
    assert text[rows[0]["h"]["start"] : rows[0]["h"]["end"]] == "$5"
    label = lambda aliases: spark.createDataFrame([("B: 1\nA: 2\nC:\na: 3",)], "t string").select(X.labelled_line(F.col("t"), aliases).alias("h")).first()["h"]
    assert label(["A", "B"])["raw"] == "2" and label(["C"]) is None and label(["a"])["raw"] == "3"


def test_noise(spark):
    assert ocr("some text 0158", "seed", 0, 0, 0) == "some text 0158"
    assert ocr("a,b.c", "s", 0, 1, 0) == "abc" and ocr("0O", "s", 1, 0, 0) == "O0"
    assert ocr("x" * 500 + "0158.", "s", 0.5, 0.5, 0.5) == ocr("x" * 500 + "0158.", "s", 0.5, 0.5, 0.5)
    u = uniforms("ocr-light|p/d", 10_000)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    lines = "\n".join(["a"] * 41 + [""])
    got = spark.createDataFrame([(lines,)], "t string").select(perturb_text(F.col("t"), "pdf-layout", F.lit("p"), F.lit("sov"))).first()[0].split("\n")
    assert got[0] == "Form SOV · Page 1" and got[41] == "— continued —" and got[42] == "Form SOV · Page 2" and got[-2:] == ["", ""]
    with pytest.raises(UnknownNoise):
        perturb_text(F.lit("x"), "fax", F.lit("p"), F.lit("d"))
