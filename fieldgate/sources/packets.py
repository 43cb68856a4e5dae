"""Packets from a directory of texts, truth from JSON, response caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DOCUMENTS, LOCATION_FIELDS, SCALARS, TEXT_FIELDS

LOCATION = "struct<" + ",".join(f"{n}:{'string' if n in TEXT_FIELDS else 'bigint'}" for n in LOCATION_FIELDS) + ">"
FIELDS = "struct<" + ",".join(f"{n}:{'string' if n in TEXT_FIELDS else 'bigint'}" for n in SCALARS) + ">"
TRUTH = f"map<string,struct<label:string,edgeCases:array<string>,notes:string,fields:{FIELDS},locations:array<{LOCATION}>>>"
CACHE = "key string, content string, input_tokens bigint, output_tokens bigint, model string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """packet_id, doc_id, name, label, doc_ord, text of every ``<path>/<packet_id>/<doc_id>.txt``; kinds that are not known come last."""
    files = spark.read.text(f"{path}/*/*.txt", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    part = lambda n: F.regexp_extract("file", "([^/]+)/([^/]+)\\.txt$", n)
    labels = F.create_map(*(F.lit(x) for pair in DOCUMENTS.items() for x in pair))
    ords = F.create_map(*(F.lit(x) for i, d in enumerate(DOCUMENTS) for x in (d, i)))
    rows = files.select(part(1).alias("packet_id"), part(2).alias("doc_id"), F.regexp_replace("text", "\r\n", "\n").alias("text"))
    return rows.select("packet_id", "doc_id", F.concat("doc_id", F.lit(".txt")).alias("name"), F.coalesce(F.try_element_at(labels, "doc_id"), "doc_id").alias("label"), F.coalesce(F.try_element_at(ords, "doc_id"), F.lit(99)).alias("doc_ord"), "text")


def list_packets(documents: DataFrame) -> DataFrame:
    return documents.select("packet_id").distinct().orderBy("packet_id")


def as_packets(documents: DataFrame) -> DataFrame:
    """packet_id and a text column per known document kind: the one shuffle of the pipeline, by packet_id."""
    return documents.groupBy("packet_id").agg(*(F.max(F.when(F.col("doc_id") == d, F.col("text"))).alias(d) for d in DOCUMENTS))


def document(documents: DataFrame, packet_id: str, doc_id: str) -> DataFrame:
    return documents.where((F.col("packet_id") == packet_id) & (F.col("doc_id") == doc_id))


def corpus_index(documents: DataFrame, by: str = "packet_id") -> DataFrame:
    """Characters and lines of each document, collected by packet in document order, with sums."""
    rows = documents.select(by, "doc_ord", "doc_id", F.length("text").alias("chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    return rows.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_ord", "doc_id", "chars", "lines"))), lambda d: F.struct(d["doc_id"].alias("doc_id"), d["chars"].alias("chars"), d["lines"].alias("lines"))).alias("documents"), F.sum("chars").alias("chars"), F.sum("lines").alias("lines"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """packet_id, label, edge_cases, notes, the scalars and locations of a truth file; keys that start with _ are metadata."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", TRUTH)).alias("packet_id", "t")).where(~F.col("packet_id").startswith("_"))
    empty = F.array().cast("array<string>")
    return rows.select("packet_id", F.coalesce("t.label", "packet_id").alias("label"), F.coalesce("t.edgeCases", empty).alias("edge_cases"), F.col("t.notes").alias("notes"), "t.fields.*", F.coalesce("t.locations", F.array().cast(f"array<{LOCATION}>")).alias("locations"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The response cache, one row per key; a missing table is an empty one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("key").agg(*(F.max(c).alias(c) for c in ("content", "input_tokens", "output_tokens", "model")))


def write_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def to_json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
