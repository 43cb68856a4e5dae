"""The pipeline's stages chained on a fixture, and each registered corpus query over the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldgate.llm.queries import oracle_sql, queries

from . import fixtures as X

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(4)
    item = X.prose(rng, 40)
    clean = [(i, X.prose(rng, 80), "en", "s", 1) for i in range(60)]
    copies = [(100 + i, clean[0][1], "en", "s", 1) for i in range(5)]
    leaks = [(200, X.prose(rng, 30) + " " + item + " " + X.prose(rng, 30), "en", "s", 1)]
    junk = [(300 + i, "".join(rng.choice("#$%&*QXZ") for _ in range(300)), "en", "s", 1) for i in range(3)]
    sf = str(tmp_path)
    spark.createDataFrame(clean + copies + leaks + junk + [(400, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(300, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out_{name}")
        before, docs = docs, spark.read.parquet(f"{sf}/out_{name}")
        left.append({r["doc_id"] for r in docs.collect()})
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == before.columns
    want = {d[0] for d in clean + copies + leaks}
    assert left[0] == want
    assert left[1] == left[2] == want - {d[0] for d in copies}
    assert left[3] == left[4] == left[2] - {200}
    assert docs.where(~F.col("exact")).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == left[4]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in oracle_sql().items():
        rows = queries()[name](spark, SF)
        columns = sorted(rows.columns)
        got = sorted(str(tuple(r[c] for c in columns)) for r in rows.collect())
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
