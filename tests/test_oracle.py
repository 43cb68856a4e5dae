"""Registered queries of the engine against DuckDB on the smallest tables."""

import glob
import os

import pytest

from fieldgate.plans.oracle import sql
from fieldgate.plans.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_entry_has_all_names():
    import __spark_entry__ as entry

    assert set(sql()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_robustness_query_runs(spark):
    rows = {r["profile"]: r for r in queries()["ocr_noise_accuracy"](spark, SF).collect()}
    assert rows["pdf-layout"]["delta_vs_clean"] == 0 and rows["ocr-heavy"]["accuracy"] <= rows["ocr-light"]["accuracy"]
