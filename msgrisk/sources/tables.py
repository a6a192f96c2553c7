"""Event and feedback tables on shared storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgrisk.operators.feedback import new_feedback
from msgrisk.schemas import split_valid, validate_feedback
from msgrisk.sources.batches import BatchTable

FEEDBACK_PARTS = 256


def event_rows(assessed: DataFrame) -> DataFrame:
    """Event-table rows of assessed messages: hashes and features, no raw text."""
    return assessed.select(
        F.col("msg_id").alias("id"),
        "sample_hash", "sender_hash", "subject_hash", "domain", "source", "risk_score", "classification",
        "confidence", "impersonated_brand", "reasons", "features",
        F.col("received_at").alias("created_at"),
        F.to_date("received_at").alias("event_date"),
    )


def write_events(assessed: DataFrame, path: str, mode: str = "append") -> None:
    """Write event rows, one folder per day, so that time filters skip whole days.

    Rows are rebalanced by day: adaptive execution cuts a day with many rows into as many files as its size
    asks for, so that it is not written by one task.
    """
    event_rows(assessed).hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def event_batches(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, ("event_date",))


def write_event_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add the event rows of one stream batch, by day; one that is repeated adds none."""
    event_batches(rows.sparkSession, path).append(rows, batch_id)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table, written by batches of a stream or as a whole."""
    batches = event_batches(spark, path)
    return batches.read() if batches.exists() else spark.read.parquet(path)


def _part(sample_hash: str = "sample_hash"):
    return F.pmod(F.xxhash64(sample_hash), F.lit(FEEDBACK_PARTS)).cast("int")


def unstored_feedback(incoming: DataFrame, path: str) -> DataFrame:
    """First feedback per key that is not stored yet, with its folder ``part``.

    The table is cut into folders by a hash of the key; only the folders that the incoming keys fall into
    are read.  Rows that break a rule are left out; ``schemas.validate_feedback`` names the rules.
    """
    spark = incoming.sparkSession
    incoming, _ = split_valid(validate_feedback(incoming))
    incoming = incoming.withColumn("part", _part())
    try:
        stored = spark.read.parquet(path).select("sample_hash", "user_feedback", "part")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = incoming.select("sample_hash", "user_feedback", "part").limit(0)
    touched = [r["part"] for r in incoming.select("part").distinct().collect()]      # FEEDBACK_PARTS at most
    return new_feedback(incoming, stored.where(F.col("part").isin(touched)))


def store_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("part").parquet(path)


def append_feedback(incoming: DataFrame, path: str) -> None:
    """Append first feedback per key that is not stored yet (single writer)."""
    store_feedback(unstored_feedback(incoming, path), path)


def write_siem(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)
