"""Domain expressions that need no reference table."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from msgrisk import fixed_values as fv
from msgrisk.functions.text import bind, flag
from msgrisk.functions.urls import entropy, host_of, labels_of


def normalize_domain(col: Column) -> Column:
    """Bare lower-case domain of an address, URL or domain."""
    value = F.btrim(F.lower(F.coalesce(col, F.lit(""))))
    value = F.when(F.contains(value, F.lit("://")), host_of(value)).otherwise(value)
    after_at = F.regexp_extract(value, r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1)
    value = (
        F.when(~F.contains(value, F.lit("@")), value)
        .when(after_at != "", after_at)
        .otherwise(F.substring_index(value, "@", -1))
    )
    return F.btrim(F.regexp_replace(value, r"^www\.", ""), F.lit("."))


def subdomain_depth(domain: Column) -> Column:
    return F.greatest(F.size(labels_of(domain)) - 2, F.lit(0))


def has_delegated_suffix(domain: Column) -> Column:
    suffixes = "|".join(s.replace(".", r"\.") for s in fv.DELEGATED_SUFFIXES)
    return domain.rlike(rf"(?:^|\.)(?:{suffixes})$")


def random_label_score(label: Column) -> Column:
    """How machine-made a label looks, 0 to 1, from its letter statistics."""
    return bind(F.regexp_replace(F.lower(label), "[^a-z0-9]", ""), _letters_score)


def _letters_score(plain: Column) -> Column:
    length = F.length(plain)

    def share(dropped: str) -> Column:
        return F.length(F.regexp_replace(plain, dropped, "")) / length

    score = (
        F.when(entropy(plain) >= 2.75, 0.45).otherwise(0.0)
        + F.when(share("[^jqxz]") >= 0.18, 0.18).otherwise(0.0)
        + F.when(share("[^0-9]") >= 0.25, 0.18).otherwise(0.0)
        + F.when(share("[^aeiou]") <= 0.22, 0.12).otherwise(0.0)
        + F.when(plain.rlike("[bcdfghjklmnpqrstvwxyz]{4,}"), 0.12).otherwise(0.0)
    )
    return F.when(length >= 7, F.round(F.least(score, F.lit(1.0)), 4)).otherwise(F.lit(0.0))


def best_random_label(domain: Column) -> Column:
    """struct(score, label): the most random label left of the last two; first one on ties."""
    parts = labels_of(domain)
    candidates = F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0)))
    scored = F.transform(
        candidates,
        lambda part, i: F.struct(
            random_label_score(part).alias("score"), (-i).alias("order"), part.alias("label")
        ),
    )
    best = F.array_max(scored)
    return F.struct(
        F.coalesce(best["score"], F.lit(0.0)).alias("score"),
        F.coalesce(best["label"], F.lit("")).alias("label"),
    )


def count_terms(col: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the column."""
    return bind(
        col, lambda value: F.size(F.filter(F.split(F.lit("|".join(terms)), r"\|"), lambda t: F.contains(value, t)))
    )


def contains_any(col: Column, terms: list[str]) -> Column:
    return col.rlike("|".join(terms))


def infrastructure_columns(domain: Column, best: Column) -> dict[str, Column]:
    """The six infrastructure features, given ``best_random_label`` as a column."""
    score = (
        best["score"] * 0.50
        + F.when(best["score"] >= 0.45, 0.20).otherwise(0.0)
        + F.when(has_delegated_suffix(domain), 0.25).otherwise(0.0)
        + F.when(subdomain_depth(domain) >= 2, 0.12).otherwise(0.0)
        + F.when(count_terms(domain, fv.INFRASTRUCTURE_TERMS) >= 2, 0.08).otherwise(0.0)
    )
    dotless = F.replace(domain, F.lit("."), F.lit(""))
    return {
        "sender_domain_entropy": F.round(entropy(dotless), 4),
        "random_label_score": best["score"],
        "random_subdomain_flag": flag(best["score"] >= 0.45),
        "suspicious_delegated_suffix_flag": flag(has_delegated_suffix(domain)),
        "domain_infrastructure_score": F.round(F.least(score, F.lit(1.0)), 4),
        "highest_entropy_label": best["label"],
    }


def has_homoglyph(col: Column, letters: str = fv.HOMOGLYPHS) -> Column:
    return col.rlike(f"[{letters}]")


def is_non_ascii(col: Column) -> Column:
    return col.rlike(r"[^\x00-\x7F]")


def skeleton(col: Column) -> Column:
    """What a label looks like once confusable characters are replaced."""
    single = {k: v for k, v in fv.CONFUSABLES.items() if len(k) == 1}
    value = F.translate(col, "".join(single), "".join(single.values()))
    for pair in (k for k in fv.CONFUSABLES if len(k) > 1):
        value = F.replace(value, F.lit(pair), F.lit(fv.CONFUSABLES[pair]))
    return F.lower(value)


def _script(char: str) -> str:
    name = unicodedata.name(char, "")
    return next((s for s in ("CYRILLIC", "GREEK", "LATIN") if s in name), "OTHER")


_FACTS = T.StructType([T.StructField("folded", T.StringType()), T.StructField("mixed", T.BooleanType())])


@F.pandas_udf(_FACTS)
def unicode_facts(host: pd.Series) -> pd.DataFrame:
    """First label in compatibility form, and script mixing, of non-ASCII hosts
    (null in, null out).

    The only Python in the scoring path: Spark has no Unicode normalisation.  It
    sees distinct hosts, and of those only the few that are not ASCII.
    """
    first = host.map(lambda h: next((p for p in h.split(".") if p), ""), na_action="ignore")
    folded = first.map(lambda p: unicodedata.normalize("NFKC", p), na_action="ignore")
    mixed = host.map(
        lambda h: len({"LATIN" if c.isascii() else _script(c) for c in h if c.isalpha()}) > 1,
        na_action="ignore",
    )
    return pd.DataFrame({"folded": folded, "mixed": mixed})
