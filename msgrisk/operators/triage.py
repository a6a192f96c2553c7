"""First-pass score from cheap checks on one message; no shuffle at all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions import domains as dom
from msgrisk.functions import urls
from msgrisk.functions.text import bind, phrase_count, text_or_empty
from msgrisk.operators.sender import reason_list

TRIAGE_THRESHOLD = 0.28
LINKS_TYPE = "array<struct<href:string,anchor_text:string>>"


def triage_text() -> Column:
    return F.lower(F.concat(text_or_empty(F.col("subject")), F.lit(" "), text_or_empty(F.col("body_text"))))


def keyword_columns() -> dict[str, Column]:
    """Phrase counts over ``_text``, the column holding ``triage_text``."""
    return {
        "kw_urgency": phrase_count("_text", fv.TRIAGE_URGENCY_PHRASES),
        "kw_credentials": phrase_count("_text", fv.TRIAGE_CREDENTIAL_PHRASES),
        "kw_financial": phrase_count("_text", fv.TRIAGE_FINANCIAL_PHRASES),
    }


def keyword_score() -> Column:
    total = F.col("kw_urgency") * 0.08 + F.col("kw_credentials") * 0.18 + F.col("kw_financial") * 0.1
    return F.least(F.lit(1.0), total)


def _triage_host(href: Column) -> Column:
    return F.regexp_replace(urls.host_of(href), r"^www\.", "")


def _triage_mismatch(anchor: Column, host: Column) -> Column:
    """As ``anchor_mismatch`` but the anchor's spelling counts, upper case included."""
    named = F.regexp_extract_all(text_or_empty(anchor), F.lit(fv.DOMAIN_IN_TEXT_PATTERN), F.lit(0))

    def last_two(name: Column) -> Column:
        return F.array_join(F.reverse(F.slice(F.reverse(urls.labels_of(name)), 1, 2)), ".")

    return (F.size(named) > 0) & F.forall(named, lambda d: last_two(d) != last_two(host))


_IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"


def link_columns() -> dict[str, Column]:
    """Counts over the link array of the message itself (no explode needed)."""
    hosted = F.transform(
        F.coalesce(F.col("links"), F.from_json(F.lit("[]"), LINKS_TYPE)),
        lambda l: F.struct(
            _triage_host(text_or_empty(l["href"])).alias("host"),
            l["anchor_text"].alias("anchor"),
            F.regexp_count(text_or_empty(l["href"]), F.lit("(?i)%[0-9A-F]{2}")).alias("encoded"),
        ),
    )

    def is_ip(host: Column) -> Column:
        return host.rlike(_IPV4) | (F.contains(host, F.lit(":")) & urls.is_ip_host(host))

    def counted(links: Column) -> Column:
        return F.struct(
            F.size(F.filter(links, lambda l: _triage_mismatch(l["anchor"], l["host"]))).alias("mismatches"),
            F.size(F.filter(links, lambda l: is_ip(l["host"]))).alias("ip"),
            F.size(
                F.filter(links, lambda l: urls.last_label(l["host"]).isin(fv.TRIAGE_SUSPICIOUS_TLDS))
            ).alias("tld"),
            F.aggregate(links, F.lit(0), lambda total, l: total + l["encoded"]).alias("encoded"),
        )

    return {"lk": bind(hosted, counted)}


def link_score() -> Column:
    total = (
        F.when(F.col("lk.mismatches") > 0, 0.28).otherwise(0.0)
        + F.when(F.col("lk.ip") > 0, 0.22).otherwise(0.0)
        + F.when(F.col("lk.tld") > 0, 0.12).otherwise(0.0)
        + F.when(F.col("lk.encoded") > 4, 0.08).otherwise(0.0)
    )
    return F.least(total, F.lit(1.0))


def claimed_sender_domain() -> Column:
    """Sender first, then the domain field."""
    sender = text_or_empty(F.col("sender_email"))
    claimed = F.when(sender != "", sender).otherwise(text_or_empty(F.col("domain")))
    return F.regexp_replace(F.lower(F.substring_index(claimed, "@", -1)), r"^www\.", "")


def mismatched_brands(text: Column, domain: Column) -> Column:
    """Names of the brands mentioned whose domains do not cover the sender domain.

    Fifteen fixed brands, filtered as an array constant: no join is needed.
    """
    table = json.dumps([{"brand": brand, "domains": domains} for brand, domains in fv.TRIAGE_BRANDS])
    brands = F.from_json(F.lit(table), "array<struct<brand:string,domains:array<string>>>")

    def unverified(own: Column):
        def test(brand: Column) -> Column:
            covers = lambda d: F.endswith(own["domain"], F.concat(F.lit("."), d))
            return F.contains(own["text"], brand["brand"]) & ~F.exists(brand["domains"], covers)

        return F.transform(F.filter(brands, test), lambda b: b["brand"])

    dotted = F.concat(F.lit("."), domain)
    return bind(F.struct(text.alias("text"), dotted.alias("domain")), unverified)


def brand_columns() -> dict[str, Column]:
    text = F.lower(F.concat_ws(" ", text_or_empty(F.col("display_name")), text_or_empty(F.col("subject"))))
    return {"br_mismatched": mismatched_brands(text, claimed_sender_domain())}


def spoof_columns() -> dict[str, Column]:
    domain = text_or_empty(F.col("domain"))
    value = F.lower(F.when(domain != "", domain).otherwise(text_or_empty(F.col("sender_email"))))
    return {
        "sp_homoglyph": F.contains(value, F.lit("xn--")) | dom.has_homoglyph(value, fv.TRIAGE_HOMOGLYPHS),
        "sp_terms": dom.count_terms(value, fv.TRIAGE_SPOOF_TERMS),
        "sp_hyphens": F.length(value) - F.length(F.replace(value, F.lit("-"), F.lit(""))),
    }


def spoof_score() -> Column:
    total = (
        F.when(F.col("sp_homoglyph"), 0.3).otherwise(0.0)
        + F.when(F.col("sp_terms") >= 2, 0.16).otherwise(0.0)
        + F.when(F.col("sp_hyphens") >= 3, 0.08).otherwise(0.0)
    )
    return F.least(total, F.lit(1.0))


def triage_reasons() -> Column:
    text = fv.TRIAGE_REASONS
    return reason_list(
        (F.col("kw_urgency") > 0, text["urgency"]),
        (F.col("kw_credentials") > 0, text["credentials"]),
        (F.col("kw_financial") > 0, text["financial"]),
        (F.col("lk.mismatches") > 0, text["anchor"]),
        (F.col("lk.ip") > 0, text["ip"]),
        (F.col("lk.tld") > 0, text["tld"]),
        (F.col("lk.encoded") > 4, text["encoding"]),
        (F.size("br_mismatched") > 0, text["brand"]),
        (F.col("sp_homoglyph"), text["homoglyph"]),
        (F.col("sp_terms") >= 2, text["terms"]),
        (F.col("sp_hyphens") >= 3, text["hyphens"]),
    )


def triage_details(messages: DataFrame) -> DataFrame:
    """Counts and the four partial scores."""
    counted = messages.withColumn("_text", triage_text()).withColumns(
        {**keyword_columns(), **link_columns(), **brand_columns(), **spoof_columns()}
    )
    return counted.withColumns(
        {
            "keyword_score": keyword_score(),
            "triage_link_score": link_score(),
            "brand_score": F.when(F.size("br_mismatched") > 0, 0.28).otherwise(0.0),
            "spoof_score": spoof_score(),
        }
    )


def triage(messages: DataFrame) -> DataFrame:
    """Set ``heuristic_score`` and ``client_reasons`` from the first-pass checks."""
    details = triage_details(messages)
    total = (
        F.col("keyword_score") * 0.25
        + F.col("triage_link_score") * 0.35
        + F.col("brand_score") * 0.25
        + F.col("spoof_score") * 0.15
    )
    kept = [c for c in messages.columns if c not in ("heuristic_score", "client_reasons")]
    return details.select(
        *kept,
        F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4).alias("heuristic_score"),
        triage_reasons().alias("client_reasons"),
    )


def has_content() -> Column:
    """Messages with neither a body nor links are not looked at."""
    return (F.length(text_or_empty(F.col("body_text"))) > 0) | (F.size("links") > 0)


def needs_full_scoring(threshold: float = TRIAGE_THRESHOLD) -> Column:
    return (F.col("heuristic_score") >= threshold) | (F.size("links") > 0)


def split_triaged(triaged: DataFrame, threshold: float = TRIAGE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows to score in full, rows already decided safe with low confidence)."""
    full = triaged.filter(needs_full_scoring(threshold))
    cheap = triaged.filter(~needs_full_scoring(threshold)).select(
        "msg_id",
        F.col("heuristic_score").alias("risk_score"),
        F.lit("safe").alias("classification"),
        F.lit("low").alias("confidence"),
        F.col("client_reasons").alias("reasons"),
        "domain",
        "source",
    )
    return full, cheap
