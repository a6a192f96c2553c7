"""Schemas of the tables and the validation rules at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from msgrisk import fixed_values as fv

LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("anchor_text", T.StringType())])

MESSAGE = T.StructType(
    [
        T.StructField("msg_id", T.LongType()),
        T.StructField("sender_email", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("domain", T.StringType()),
        T.StructField("heuristic_score", T.DoubleType()),
        T.StructField("sender_local_category", T.StringType()),
        T.StructField("client_reasons", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("feedback_id", T.LongType()),
        T.StructField("sample_hash", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("current_risk_score", T.DoubleType()),
        T.StructField("current_classification", T.StringType()),
        T.StructField("user_feedback", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def with_defaults(df: DataFrame) -> DataFrame:
    """Add missing optional message columns and replace nulls by their defaults."""
    defaults = {
        "sender_email": F.lit(""), "display_name": F.lit(""), "subject": F.lit(""),
        "body_text": F.lit(""), "html": F.lit(None).cast("string"), "domain": F.lit(""),
        "links": F.from_json(F.lit("[]"), T.ArrayType(LINK)),
        "heuristic_score": F.lit(0.0), "sender_local_category": F.lit(None).cast("string"),
        "client_reasons": F.expr("cast(array() as array<string>)"), "source": F.lit("generic"),
    }
    columns = {}
    for name, default in defaults.items():
        columns[name] = F.coalesce(F.col(name), default) if name in df.columns else default
    return df.withColumns(columns)


def _violations(checks: dict[str, Column]) -> Column:
    names = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in checks.items()]
    return F.filter(F.array(*names), lambda name: name.isNotNull())


def message_violations() -> Column:
    """Names of the rules a message breaks, as an array column."""
    checks = {"msg_id": F.col("msg_id").isNull()}
    checks |= {name: F.length(name) > limit for name, limit in fv.MAX_LENGTHS.items()}
    checks["links"] = F.size("links") > fv.MAX_LINKS
    checks["href"] = F.exists("links", lambda l: l["href"].isNull() | (F.length(l["href"]) > fv.MAX_HREF))
    checks["anchor_text"] = F.exists("links", lambda l: F.length(l["anchor_text"]) > fv.MAX_ANCHOR)
    checks["heuristic_score"] = ~F.col("heuristic_score").between(0.0, 1.0)
    checks["sender_local_category"] = ~F.col("sender_local_category").isin(fv.LOCAL_CATEGORIES)
    checks["client_reasons"] = F.size("client_reasons") > fv.MAX_REASONS
    checks["client_reason"] = F.exists("client_reasons", lambda r: F.length(r) > fv.REASON_LENGTH)
    checks["source"] = ~F.col("source").isin(fv.MESSAGE_SOURCES)
    return _violations(checks)


def feedback_violations() -> Column:
    return _violations(
        {
            "sample_hash": F.col("sample_hash").isNull() | ~F.length("sample_hash").between(16, 128),
            "domain": F.length("domain") > 255,
            "source": F.length("source") > 64,
            "current_risk_score": ~F.col("current_risk_score").between(0.0, 1.0),
            "current_classification": F.length("current_classification") > 32,
            "user_feedback": F.col("user_feedback").isNull() | ~F.col("user_feedback").isin(fv.FEEDBACK_KINDS),
            "reasons": F.size("reasons") > fv.MAX_REASONS,
            "reason": F.exists("reasons", lambda r: F.length(r) > fv.REASON_LENGTH),
        }
    )


def validate_messages(df: DataFrame) -> DataFrame:
    """Add ``violations``, the names of the rules a row breaks.  Valid rows have none; nothing is cut."""
    return df.withColumn("violations", message_violations())


def validate_feedback(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", feedback_violations())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) of a validated table."""
    good = F.size("violations") == 0
    return df.filter(good).drop("violations"), df.filter(~good)
