"""The append-only review log: validation, append, latest and history, and the queue of packets that wait for a human."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .diff import latest
from .rules import low_confidence

DECISIONS = ("approve", "decline", "needs-info")
MOST_NOTE, MOST_REVIEWER = 2000, 120
SCHEMA = "id string, packetId string, versionId string, runId string, decision string, reviewer string, note string, recordedAt timestamp"


class BadReview(ValueError):
    """A review that can't be recorded."""


def validate(packetId: str | None, versionId: str | None, decision: str | None, reviewer: str | None = None, note: str | None = None, runId: str | None = None) -> dict:
    """The review as it is stored, or an error."""
    clean = lambda x: (x or "").strip()
    if not clean(packetId) or not clean(versionId):
        raise BadReview("packetId and versionId are needed")
    if decision not in DECISIONS:
        raise BadReview(f"decision must be one of {', '.join(DECISIONS)}")
    if decision == "needs-info" and not clean(note):
        raise BadReview("needs-info needs a note")
    return {"packetId": clean(packetId), "versionId": clean(versionId), "runId": runId, "decision": decision, "reviewer": clean(reviewer)[:MOST_REVIEWER] or "unattributed", "note": clean(note)[:MOST_NOTE]}


def append_review(spark: SparkSession, path: str, **review: str) -> None:
    """One more file in the log's folder; the committer makes it appear whole or not at all, and a failed append leaves later ones alone."""
    row = validate(**review)
    one = spark.createDataFrame([row], "packetId string, versionId string, runId string, decision string, reviewer string, note string")
    one.select(F.expr("uuid()").alias("id"), *one.columns, F.current_timestamp().alias("recordedAt")).coalesce(1).write.mode("append").parquet(path)


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The log; a missing one is empty, a corrupt one an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def clear_reviews(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)


def latest_by_packet(reviews: DataFrame, order: str = "recordedAt", version_id: str | None = None) -> DataFrame:
    """The last review of each packet and version, in append order; the group's maximum is aggregated before the shuffle."""
    rows = reviews if version_id is None else reviews.where(F.col("versionId") == version_id)
    return latest(rows, ["versionId", "packetId"], order)


def history(reviews: DataFrame, packet_id: str, order: str = "recordedAt") -> DataFrame:
    return reviews.where(F.col("packetId") == packet_id).orderBy(order)


def review_queue(runs: DataFrame, reviews: DataFrame | None = None, order: str = "recordedAt") -> DataFrame:
    """Abstained packets with reasons, checks that didn't pass, conflicts, weak fields, totals and the latest review. It reads runs and reviews only:
    no column of truth or accuracy can be in it."""
    waiting = runs.where("routing.abstained")
    weak = low_confidence(waiting).groupBy("version_id", "packet_id").agg(F.sort_array(F.collect_list(F.struct("key", "confidence", "method"))).alias("low_confidence"))
    out = waiting.select(
        "version_id",
        "packet_id",
        F.col("routing.reasons").alias("reasons"),
        F.filter("checks", lambda c: c["status"] != "pass").alias("open_checks"),
        "conflicts",
        "listed_tiv",
        "computed_tiv",
    ).join(weak, ["version_id", "packet_id"], "left")
    if reviews is None:
        return out
    last = latest_by_packet(reviews, order).select(F.col("versionId").alias("version_id"), F.col("packetId").alias("packet_id"), F.col("decision").alias("review_decision"), F.col("reviewer").alias("reviewer"))
    return out.join(last, ["version_id", "packet_id"], "left").withColumn("cleared", F.coalesce(F.col("review_decision").isin("approve", "decline"), F.lit(False)))
