"""Score fusion, classes and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from msgrisk import fixed_values as fv


def fallback_probability() -> Column:
    """Weighted sum of capped features, used when no trained model is given."""
    total = F.lit(0.0)
    for name, full, weight in fv.FALLBACK_WEIGHTS:
        total = total + F.least(F.coalesce(F.col(name), F.lit(0.0)) / full, F.lit(1.0)) * weight
    return F.round(F.least(F.greatest(total, F.lit(0.02)), F.lit(0.98)), 4)


def assessment_reasons() -> Column:
    """Reasons drawn from the features themselves, in a fixed order."""
    lookalike = (F.col("lookalike_score") >= 0.35) | (F.col("url_lookalike_score") >= 0.35)
    pairs = [
        (F.col("ml_probability") >= 0.7, fv.REASON_MODEL),
        (F.col("credential_phrase_count") > 0, fv.REASON_CREDENTIAL),
        (F.col("promotional_spam_score") >= 0.45, fv.REASON_PROMO),
        (F.col("defanged_url_count") > 0, fv.REASON_DEFANGED),
        ((F.col("urgency_keyword_count") > 0) & lookalike, fv.REASON_URGENT_LOOKALIKE),
        (F.col("anchor_mismatch_flag") > 0, fv.REASON_ANCHOR),
    ]
    return F.filter(
        F.array(*[F.when(condition, F.lit(reason)) for condition, reason in pairs]),
        lambda r: r.isNotNull(),
    )


def fused_score(
    ml: Column, impersonation: Column, heuristic: Column, reputation: Column, registry_mismatch: Column,
    reasons: Column, trusted: Column, category: Column,
) -> Column:
    """Weighted components, raised by the floors, lowered for trusted notices.

    Reasons steer two floors, so a reason supplied by the client can raise a score.
    """
    score = (
        0.30 * ml + 0.25 * impersonation + 0.20 * heuristic + 0.15 * reputation + 0.10 * registry_mismatch
    )
    floor = F.when(reputation >= 0.90, 0.34).when(reputation >= 0.65, 0.32).otherwise(0.0)
    promo = F.exists(reasons, lambda r: F.contains(r, F.lit("gambling or prize-lure spam")))
    lookalike = F.exists(
        reasons,
        lambda r: F.contains(F.lower(r), F.lit("lookalike")) | F.contains(F.lower(r), F.lit("look-alike")),
    )
    score = F.greatest(
        score,
        floor,
        F.when(promo, 0.34).otherwise(0.0),
        F.when(lookalike, 0.38).otherwise(0.0),
    )
    notice = trusted & category.isin("noreply", "notification")
    score = F.when(notice, F.greatest(score - 0.04, F.lit(0.0))).otherwise(score)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4)


def classification(score: Column) -> Column:
    return F.when(score >= 0.72, "phishing").when(score >= 0.32, "suspicious").otherwise("safe")


def confidence(score: Column) -> Column:
    return (
        F.when((score >= 0.78) | (score <= 0.15), "high")
        .when((score >= 0.52) | (score <= 0.26), "medium")
        .otherwise("low")
    )
