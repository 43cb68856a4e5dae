"""The corpus pipeline: documents are filtered, their lines and then they themselves deduplicated, decontaminated and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents, with every row that they keep.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldgate.llm.byte_bpe import encode_documents
from fieldgate.llm.common import discard, holding, materialize
from fieldgate.llm.decontaminate import decontaminate
from fieldgate.llm.kneser_ney import HELD_OUT, keep_good
from fieldgate.llm.line_dedup import dedup_lines
from fieldgate.llm.simhash import keep_one


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier (operator 8), fitted on the trusted ones among these, doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), turns=HELD_OUT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fuzzy lines (operator 1) one line stays; documents all of whose lines stay elsewhere go."""
    return dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 3 bits (operator 6) the document with the smallest doc_id."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 9: five-word shingles, similarity 0.8 or more)."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document (operator 5), their digest, and that of the bytes that they decode to."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL expresses none of the stages but the last row filter; the pipeline is tested against brute-force versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        kept = materialize(result, name)
        discard(result, docs)
        docs = kept
    return holding(STAGES[-1][1](spark, docs, sf_dir), docs)
