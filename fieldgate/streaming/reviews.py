"""Latest review decisions from the growing log, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reviews import SCHEMA


def stream_reviews(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def latest_stream(reviews: DataFrame) -> DataFrame:
    """The last review of each version and packet; state is one row each, partial maxima are taken before the shuffle. Output mode complete or update."""
    return reviews.groupBy("versionId", "packetId").agg(F.max_by(F.struct("decision", "reviewer", "note"), "recordedAt").alias("r"), F.max("recordedAt").alias("recordedAt")).select("versionId", "packetId", "r.*", "recordedAt")
