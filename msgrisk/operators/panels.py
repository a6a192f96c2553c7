"""The dashboard's panels from partial aggregates that can be merged.

Events are folded to counts and sums per class, minute and brand, and to the newest few; so are those of a
batch, and folds merge to the fold of all.  A refresh takes in the batch that has arrived and no old event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from msgrisk.operators.analytics import newest

SHOWN = 25              # newest rows of a panel
BRANDS = 10
KEEP_DAYS = 400         # minutes older than this before the newest one are dropped
FOLD = "panel string, item string, at timestamp, n_events long, risk double"
PANEL = "panel string, item string, n_events long, average_risk double"
_NEWEST = ("recent", "feedback")


def _newest_rows(rows: DataFrame, panel: str, item: str, risk: str) -> DataFrame:
    return newest(rows, SHOWN, item).select(
        F.lit(panel).alias("panel"), F.col(item).cast("string").alias("item"), F.col("created_at").alias("at"),
        F.lit(1).cast("long").alias("n_events"), F.col(risk).cast("double").alias("risk"),
    )


def event_fold(events: DataFrame) -> DataFrame:
    """Counts and sums of risk per class, minute and brand, and the newest events."""

    def entry(panel: str, item: Column, at: Column) -> Column:
        return F.struct(F.lit(panel).alias("panel"), item.cast("string").alias("item"), at.cast("timestamp").alias("at"))

    none = F.lit(None)
    entries = F.array(
        entry("classes", F.col("classification"), none), entry("trend", none, F.date_trunc("minute", "created_at")),
        entry("brands", F.col("impersonated_brand"), none),
    )
    rows = events.select(F.explode(entries).alias("e"), F.col("risk_score").cast("double").alias("risk")).select("e.*", "risk")
    rows = rows.where((F.col("panel") != "brands") | F.col("item").isNotNull())
    counted = rows.groupBy("panel", "item", "at").agg(F.count("*").alias("n_events"), F.sum("risk").alias("risk"))
    return counted.unionByName(_newest_rows(events, "recent", "id", "risk_score"))


def feedback_fold(feedback: DataFrame) -> DataFrame:
    """The newest feedback."""
    return _newest_rows(feedback, "feedback", "feedback_id", "current_risk_score")


def merged(folds: DataFrame) -> DataFrame:
    """Folds as one; merging what was merged before changes nothing."""
    counted = folds.where(~F.col("panel").isin(*_NEWEST)).groupBy("panel", "item", "at").agg(
        F.sum("n_events").alias("n_events"), F.sum("risk").alias("risk"))
    last = Window.partitionBy("panel")      # a row for each minute, class and brand: not for each event
    counted = counted.withColumn("_last", F.max("at").over(last))
    counted = counted.where(F.col("at").isNull() | (F.col("at") >= F.col("_last") - F.make_dt_interval(F.lit(KEEP_DAYS)))).drop("_last")
    order = Window.partitionBy("panel").orderBy(F.desc("at"), F.expr("try_cast(item AS bigint)").desc(), F.desc("item"))
    few = folds.where(F.col("panel").isin(*_NEWEST)).withColumn("_place", F.row_number().over(order))
    return counted.unionByName(few.where(F.col("_place") <= SHOWN).drop("_place"))


def panels(fold: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """The rows shown (panel, item, n_events, average_risk); the trend begins ``days`` before the minute of ``as_of``."""
    average = F.round(F.col("risk") / F.col("n_events"), 4).alias("average_risk")
    start = F.date_trunc("minute", F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    trend = fold.where((F.col("panel") == "trend") & (F.col("at") >= start)).groupBy(F.to_date("at").cast("string").alias("item"))
    trend = trend.agg(F.sum("n_events").alias("n_events"), F.sum("risk").alias("risk"))
    brands = fold.where("panel = 'brands'").orderBy(F.desc("n_events"), "item").limit(BRANDS)
    shown = fold.where(F.col("panel").isin("classes", *_NEWEST))
    out = shown.select("panel", "item", "n_events", average)
    for name, rows in (("trend", trend), ("brands", brands)):
        out = out.unionByName(rows.select(F.lit(name).alias("panel"), "item", "n_events", average))
    return out
