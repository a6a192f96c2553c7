"""Named detection rules over texts and feature flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgrisk import fixed_values as fv


def rule_fires(patterns: list[str], text: Column, flags: dict[str, Column]) -> Column:
    """Any pattern holds: a feature flag above 0, or a phrase found in the text."""
    fired = F.lit(False)
    for pattern in patterns:
        hit = flags[pattern] > 0 if pattern in flags else F.contains(text, F.lit(pattern))
        fired = fired | F.coalesce(hit, F.lit(False))
    return fired


def rule_hits(df: DataFrame, text: str, flags: dict[str, Column], rules=None) -> DataFrame:
    """One row per message and rule that fires: msg_id, rule_id, rule_name, severity."""
    lowered = F.lower(F.col(text))
    hits = [
        F.when(
            rule_fires(patterns, F.col("_lower"), flags),
            F.struct(F.lit(rid).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(sev).alias("severity")),
        )
        for rid, name, sev, patterns in (rules or fv.DETECTION_RULES)
    ]
    fired = df.withColumn("_lower", lowered).select(
        "msg_id", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("hit")
    )
    return fired.select("msg_id", "hit.*")
