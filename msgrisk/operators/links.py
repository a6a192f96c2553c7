"""Link-level work: one row per reference to a host, joined with the host profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions import urls
from msgrisk.operators import names
from msgrisk.operators.hosts import host_profile, membership_columns
from msgrisk.registry import Registry
from msgrisk.session import store


def path_brand(path: Column, registry: Registry) -> Column:
    """First brand in registry order with a verified domain in the URL path."""
    return F.get(names.first_names(registry.domains, F.when(F.contains(path, F.lit(".")), path)), F.lit(0))


def url_path(href: Column) -> Column:
    """Path of the refanged URL in lower case."""
    return urls.path_of(F.lower(urls.refang(href)))


def host_references(df: DataFrame, registry: Registry, sender_host: Column | None = None) -> DataFrame:
    """One row per link, plus one per message for its sender domain if given.

    Only the message id and the link columns are read here, never the bodies.
    Facts are added after the explode, stage by stage, so that each host and path
    is cut out of its URL once.
    """
    items = F.transform(
        F.col("links"),
        lambda l: F.struct(
            F.lit(False).alias("is_sender"),
            F.coalesce(l["href"], F.lit("")).alias("href"),
            l["anchor_text"].alias("anchor_text"),
        ),
    )
    if sender_host is not None:
        sender = F.struct(
            F.lit(True).alias("is_sender"), F.lit("").alias("href"), F.lit("").alias("anchor_text")
        )
        items = F.concat(F.array(sender), items)
        rows = df.withColumn("_sender", sender_host).select(
            "msg_id", "_sender", F.explode(items).alias("ref")
        )
    else:
        rows = df.select("msg_id", F.lit("").alias("_sender"), F.explode(items).alias("ref"))
    rows = rows.select("msg_id", "_sender", "ref.*").withColumns(
        {"plain_host": urls.host_of(F.col("href")), "refanged": urls.refang(F.col("href"))}
    )
    rows = rows.withColumns(
        {
            "host": F.when(F.col("is_sender"), F.col("_sender")).otherwise(urls.host_of(F.col("refanged"))),
            "path": urls.path_of(F.lower("refanged")),
        }
    )
    href, plain = F.col("href"), F.col("plain_host")
    member = membership_columns(plain)
    return rows.select(
        "msg_id",
        "is_sender",
        "host",
        (href != "").alias("has_url"),
        urls.anchor_mismatch(F.col("anchor_text"), plain).alias("mismatch"),
        urls.entropy(href).alias("entropy"),
        urls.encoded_characters(href).alias("encoded"),
        (urls.percent_count(href) > 4).alias("heavy_encoding"),
        path_brand(F.col("path"), registry).isNotNull().alias("path_hit"),
        member["ip_host"].alias("ip_host"),
        member["blocklisted"].alias("blocklisted"),
        member["suspicious_tld"].alias("suspicious_tld"),
        F.when(F.contains(plain, F.lit(".")) & member["suspicious_tld"], urls.last_label(plain)).alias("tld"),
    )


def host_usage(df: DataFrame, sender_host: Column | None = None) -> DataFrame:
    """How often each host is referred to, and whether as a sender domain.

    Computed from the hosts alone, apart from ``host_references``, so that the
    counting pass does none of the per-link work.
    """
    used = F.transform(
        F.col("links"),
        lambda l: F.struct(
            F.lit(False).alias("is_sender"),
            urls.host_of(urls.refang(F.coalesce(l["href"], F.lit("")))).alias("host"),
        ),
    )
    if sender_host is not None:
        used = F.concat(
            F.array(F.struct(F.lit(True).alias("is_sender"), sender_host.alias("host"))), used
        )
    return (
        df.select(F.explode(used).alias("use"))
        .groupBy("use.host")
        .agg(F.count("*").alias("n_refs"), F.max("use.is_sender").alias("is_sender"))
    )


def join_profile(refs: DataFrame, usage: DataFrame, registry: Registry) -> DataFrame:
    """Join every reference with the profile of its host.

    ``usage`` (best a stored table) gives the distinct hosts.  The join key is the reversed host, a
    one-to-one image: the profile is grouped by host already, and only a join that shuffles both sides anew
    is split by adaptive execution where one host holds a large part of all references.
    """
    profile = host_profile(usage.select("host", "is_sender"), registry).drop("is_sender")
    profile = profile.withColumn("_key", F.reverse("host")).drop("host")
    return refs.withColumn("_key", F.reverse("host")).join(profile, "_key").drop("_key")


def link_scores() -> dict[str, Column]:
    """Look-alike score, flags, points and reasons of one profiled link."""
    untrusted = F.col("trust_brand").isNull()
    path_flag = F.col("path_hit") & untrusted
    shortener = F.col("host").isin(fv.SHORTENERS)
    score = F.round(
        F.least(
            F.col("lookalike_score")
            + F.when(path_flag, 0.35).otherwise(0.0)
            + F.when(shortener, 0.20).otherwise(0.0),
            F.lit(1.0),
        ),
        4,
    )
    tld_hit = F.col("tld").isNotNull()
    encoding = F.col("heavy_encoding") & untrusted
    checks = [
        (F.col("blocklisted"), F.lit(0.45), F.lit(fv.REASON_BLOCKLIST)),
        (F.col("ip_host"), F.lit(0.22), F.lit(fv.REASON_IP_URL)),
        (tld_hit, F.lit(0.12), F.concat(F.lit(fv.REASON_TLD_PREFIX), F.col("tld"))),
        (encoding, F.lit(0.08), F.lit(fv.REASON_ENCODING)),
        (path_flag, F.lit(0.26), F.lit(fv.REASON_PATH_BRAND)),
        (shortener, F.lit(0.12), F.lit(fv.REASON_SHORTENER)),
        (F.col("url_lookalike") >= 0.35, F.least("url_lookalike", F.lit(0.45)), F.lit(fv.REASON_URL_LOOKALIKE)),
    ]
    points = F.lit(0.0)
    for condition, value, _ in checks:
        points = points + F.when(condition, value).otherwise(0.0)
    return {
        "url_lookalike": score,
        "path_flag": path_flag,
        "shortener": shortener,
        "points": points,
        "link_reasons": F.filter(
            F.array(*[F.when(condition, reason) for condition, _, reason in checks]),
            lambda r: r.isNotNull(),
        ),
    }


def add_link_scores(refs: DataFrame) -> DataFrame:
    columns = link_scores()
    first = refs.withColumn("url_lookalike", columns.pop("url_lookalike"))
    return first.withColumns(columns)


def link_aggregates() -> list[Column]:
    """Per-message link features and link reputation over the scored references.

    The points have at most four decimals; summing them as decimals makes the sum
    independent of the order in which tasks deliver them.
    """
    url = F.col("has_url")
    is_link = ~F.col("is_sender")

    def any_of(condition: Column) -> Column:
        return F.coalesce(F.max(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))

    n_urls = F.count_if(url)
    points = F.sum(F.when(is_link, F.col("points").cast("decimal(12,4)")))
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(is_link, F.col("link_reasons"))))))
    return [
        n_urls.cast("double").alias("url_count"),
        any_of(F.col("mismatch")).alias("anchor_mismatch_flag"),
        F.count_if("mismatch").cast("double").alias("anchor_mismatch_count"),
        F.round(F.coalesce(F.avg(F.when(url, F.col("entropy"))), F.lit(0.0)), 4).alias("url_entropy_avg"),
        F.round(F.coalesce(F.max(F.when(url, F.col("entropy"))), F.lit(0.0)), 4).alias("url_entropy_max"),
        any_of(url & F.col("ip_host")).alias("ip_based_url_flag"),
        F.round(F.count_if(url & F.col("suspicious_tld")) / F.greatest(n_urls, F.lit(1)), 4).alias(
            "suspicious_tld_score"
        ),
        F.coalesce(F.sum(F.when(url, F.col("encoded"))), F.lit(0.0)).alias("encoded_character_count"),
        F.round(F.coalesce(F.max(F.when(url, F.col("url_lookalike"))), F.lit(0.0)), 4).alias(
            "url_lookalike_score"
        ),
        any_of(url & F.col("path_flag")).alias("url_brand_in_path_flag"),
        any_of(url & F.col("shortener")).alias("generic_shortener_flag"),
        F.round(F.least(F.coalesce(points, F.lit(0)).cast("double"), F.lit(1.0)), 4).alias("link_points"),
        reasons.alias("link_reasons"),
    ]


LINK_FEATURES = [
    "url_count", "anchor_mismatch_flag", "anchor_mismatch_count", "url_entropy_avg", "url_entropy_max",
    "ip_based_url_flag", "suspicious_tld_score", "encoded_character_count", "url_lookalike_score",
    "url_brand_in_path_flag", "generic_shortener_flag",
]


def link_features(messages: DataFrame, registry: Registry) -> DataFrame:
    """Link features and link reputation, one row per message."""
    refs = host_references(messages, registry)
    scored = add_link_scores(join_profile(refs, store(host_usage(messages)), registry))
    per_message = scored.groupBy("msg_id").agg(*link_aggregates())
    none = {name: 0.0 for name in [*LINK_FEATURES, "link_points"]}
    joined = messages.select("msg_id").join(per_message, "msg_id", "left").fillna(none)
    return joined.withColumn(
        "link_reasons", F.coalesce("link_reasons", F.expr("cast(array() as array<string>)"))
    )
