"""Sender features, impersonation score and sender-domain reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions import domains as dom
from msgrisk.functions.text import flag, text_or_empty
from msgrisk.operators import names
from msgrisk.registry import Registry


def reason_list(*pairs: tuple[Column, str]) -> Column:
    """Reasons whose condition holds, in the given order."""
    return F.filter(
        F.array(*[F.when(condition, F.lit(reason)) for condition, reason in pairs]),
        lambda r: r.isNotNull(),
    )


def sorted_union(*lists: Column) -> Column:
    """Distinct non-empty reasons of several lists in sorted order."""
    return F.array_sort(F.array_distinct(F.filter(F.concat(*lists), lambda r: r != "")))


def sender_host(domain: Column, sender: Column) -> Column:
    """Normalised sender domain: the domain field if filled, else the address."""
    return dom.normalize_domain(F.when(text_or_empty(domain) != "", domain).otherwise(sender))


def add_first_mentions(df: DataFrame, texts: dict[str, Column], registry: Registry) -> DataFrame:
    """For each named text a column: the first brand in registry order that it mentions."""
    whole = registry.mention_mode == "word"
    found = df.withColumn("_found", names.first_names(registry.aliases, *(F.lower(t) for t in texts.values()), whole_words=whole))
    return found.withColumns({name: F.get("_found", F.lit(i)) for i, name in enumerate(texts)}).drop("_found")


def brand_mentions(text: Column, registry: Registry) -> Column:
    """All mentioned brands in registry order."""
    return names.all_names(registry.aliases, F.lower(text), registry.mention_mode == "word")


def mention_text(name: Column, subject: Column, *more: Column) -> Column:
    parts = [text_or_empty(name), text_or_empty(subject), *more]
    return F.concat_ws(" ", *parts)


def sender_columns() -> dict[str, Column]:
    """Sender features from the host profile and ``mention`` (name and subject)."""
    host = F.col("normalized_domain")
    verified = F.col("verified_brand")
    close = F.when(F.col("near_distance") <= 0.34, F.col("near_brand"))
    return {
        "recognized_brand": verified,
        "domain_trust_type": F.col("trust_type"),
        "punycode_detection": flag(F.contains(host, F.lit("xn--"))),
        "subdomain_depth": dom.subdomain_depth(host).cast("double"),
        "levenshtein_distance_to_brand": F.col("near_distance"),
        "display_name_mismatch": flag(F.col("mention").isNotNull() & verified.isNull()),
        "domain_registry_mismatch": flag(close.isNotNull() & verified.isNull()),
        "likely_brand": F.coalesce(verified, F.col("mention"), close, F.col("lookalike_brand")),
    }


def impersonation_columns() -> dict[str, Column]:
    """Impersonation score, brand and reasons from the sender features and
    ``wide_mention`` (name, subject and domain)."""
    host = F.col("normalized_domain")
    mention, verified = F.col("wide_mention"), F.col("recognized_brand")
    checks = [
        (mention.isNotNull() & verified.isNull(), 0.34, fv.REASON_BRAND_MENTION),
        (F.col("display_name_mismatch") > 0, 0.18, fv.REASON_NAME_MISMATCH),
        (F.col("domain_registry_mismatch") > 0, 0.22, fv.REASON_NEAR_BRAND),
        (dom.has_homoglyph(host), 0.16, fv.REASON_HOMOGLYPH),
        (dom.contains_any(host, fv.SPOOF_TERMS), 0.10, fv.REASON_SPOOF_TERM),
    ]
    score = F.lit(0.0)
    for condition, points, _ in checks:
        score = score + F.when(condition, points).otherwise(0.0)
    score = F.when(verified.isNotNull(), F.greatest(score - 0.22, F.lit(0.0))).otherwise(score)
    near = F.when(F.col("domain_registry_mismatch") > 0, F.col("likely_brand"))
    return {
        "impersonation_score": F.round(F.least(score, F.lit(1.0)), 4),
        "impersonated_brand": F.when(verified.isNull(), F.coalesce(mention, near)),
        "impersonation_reasons": reason_list(*[(c, r) for c, _, r in checks]),
    }


def domain_reputation_columns() -> dict[str, Column]:
    """Reputation of the sender domain; verified senders are exempt."""
    exempt = F.col("strong_sender") | (F.col("normalized_domain") == "")
    score = F.greatest("domain_infrastructure_score", "lookalike_score")
    reasons = reason_list(
        (F.col("random_subdomain_flag") > 0, fv.REASON_RANDOM_LABEL),
        (F.col("suspicious_delegated_suffix_flag") > 0, fv.REASON_DELEGATED),
        (F.col("random_label_score") >= 0.6, fv.REASON_MACHINE),
        (F.col("homograph_flag") > 0, fv.REASON_HOMOGRAPH),
        (F.col("mixed_script_flag") > 0, fv.REASON_MIXED_SCRIPT),
        (F.col("typosquat_flag") > 0, fv.REASON_TYPOSQUAT),
        (F.col("brand_in_subdomain_flag") > 0, fv.REASON_BRAND_SUBDOMAIN),
        (F.col("suspicious_hyphenated_brand_flag") > 0, fv.REASON_HYPHEN_BRAND),
    )
    nothing = F.expr("cast(array() as array<string>)")
    return {
        "domain_reputation": F.when(exempt, F.lit(0.0)).otherwise(F.round(F.least(score, F.lit(1.0)), 4)),
        "domain_reasons": F.when(exempt, nothing).otherwise(reasons),
    }
