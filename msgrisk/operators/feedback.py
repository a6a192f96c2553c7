"""User feedback: one row per message and kind, the first one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["sample_hash", "user_feedback"]


def first_feedback(feedback: DataFrame) -> DataFrame:
    """Earliest row per key.  An aggregate, not a window: partial results combine
    before the shuffle, so a key with very many repeats costs one row per task."""
    others = [c for c in feedback.columns if c not in KEY]
    first = F.min_by(F.struct(*others), F.struct("created_at", "feedback_id")).alias("first")
    return feedback.groupBy(*KEY).agg(first).select(*KEY, "first.*")


def new_feedback(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append: first per key, key not stored yet, marked for review."""
    fresh = first_feedback(incoming).join(stored.select(*KEY).distinct(), KEY, "left_anti")
    return fresh.withColumn("review_status", F.lit("pending"))
