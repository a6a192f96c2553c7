"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from msgrisk import fixed_values as fv
from msgrisk import schemas
from msgrisk.functions import domains as dom
from msgrisk.functions import privacy, scoring, structure, urls
from msgrisk.functions.text import add_text_features
from msgrisk.operators import analytics, feedback as fb, hosts, learning, ledger, links, rules, sender, triage
from msgrisk.plans import assess as plan
from msgrisk.plans import demo, training
from msgrisk.registry import Registry
from msgrisk.session import apply_settings, checkpoint_root, store
from msgrisk.sources import feeds, messages as source, tables
from msgrisk.streaming import jobs

REG = Registry.sample()
AS_OF = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(apply_settings(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def joined(col: str):
    return F.array_join(col, " | ")


def masked(spark, sf_dir) -> DataFrame:
    return plan.mask_messages(schemas.with_defaults(demo.messages(spark, sf_dir)))


def exploded_links(spark, sf_dir) -> DataFrame:
    """Links of the masked messages, one row each."""
    rows = masked(spark, sf_dir).select("msg_id", F.explode("links").alias("l"))
    return rows.select("msg_id", F.col("l.href").alias("href"), F.col("l.anchor_text").alias("anchor"))


def distinct_hosts(spark, sf_dir) -> DataFrame:
    """All hosts of the messages, one row each."""
    rows = masked(spark, sf_dir)
    return links.host_usage(rows, sender.sender_host(F.col("domain"), F.col("sender_email"))).select("host")


def features(spark, sf_dir) -> DataFrame:
    return plan.extract_features(masked(spark, sf_dir), REG)


def scored(spark, sf_dir) -> DataFrame:
    triaged = triage.triage(demo.messages(spark, sf_dir))
    rows = plan.extract_features(plan.mask_messages(schemas.with_defaults(triaged)), REG)
    return plan.score_features(rows)


def assessed(spark, sf_dir) -> DataFrame:
    """Every document, also those too long for a valid message."""
    return plan.assess(triage.triage(demo.messages(spark, sf_dir)), REG, key=demo.HMAC_KEY, valid_only=False)


# ---------------------------------------------------------------------- privacy
@query
def mask_pii(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(privacy.mask_pii(F.col("text"))).alias("masked_md5"))


@query
def mask_turns(spark, sf_dir):
    turns = demo.table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", F.md5(privacy.mask_pii(F.col("text"), cards=False)).alias("masked_md5")
    )


@query
def sender_category(spark, sf_dir):
    return demo.messages(spark, sf_dir).select(
        "msg_id",
        privacy.local_category(F.col("sender_email")).alias("category"),
        privacy.mask_address(F.col("sender_email")).alias("masked_sender"),
    )


@query
def mask_payload(spark, sf_dir):
    return masked(spark, sf_dir).select(
        "msg_id", "sender_email", "display_name", "subject", F.md5("body_text").alias("body_md5"),
        joined("links.anchor_text").alias("anchors"), joined("links.href").alias("hrefs"), "domain",
    )


@query
def hmac_ids(spark, sf_dir):
    return demo.messages(spark, sf_dir).select(
        "msg_id",
        privacy.hmac_sha256(F.col("sender_email"), demo.HMAC_KEY).alias("sender_hash"),
        privacy.hmac_sha256(F.col("subject"), demo.HMAC_KEY).alias("subject_hash"),
    )


@query
def canonical_hash(spark, sf_dir):
    return demo.messages(spark, sf_dir).select(
        "msg_id",
        privacy.canonical_hash(
            F.col("sender_email"), F.col("subject"), F.col("body_text"), F.col("links")
        ).alias("sample_hash"),
    )


# ------------------------------------------------------------------------- text
def _text(spark, sf_dir):
    return add_text_features(masked(spark, sf_dir))


@query
def text_stats(spark, sf_dir):
    return _text(spark, sf_dir).select(
        "msg_id", "word_count", "unique_word_ratio", "uppercase_ratio", "exclamation_count", "emoji_count",
        F.md5("text").alias("text_md5"),
    )


@query
def phrase_counts(spark, sf_dir):
    return _text(spark, sf_dir).select(
        "msg_id", "urgency_keyword_count", "credential_phrase_count", "high_risk_phrase_count",
        "spam_lure_keyword_count", "gambling_keyword_count", "hindi_spam_lure_count",
    )


@query
def promo_score(spark, sf_dir):
    return _text(spark, sf_dir).select("msg_id", "promotional_spam_score")


@query
def defanged_count(spark, sf_dir):
    found = _text(spark, sf_dir).withColumn("domains", urls.domains_in_text(F.col("text")))
    return found.select("msg_id", "defanged_url_count", joined("domains").alias("domains"))


# ------------------------------------------------------------------ links and URLs
@query
def url_hosts(spark, sf_dir):
    href = F.col("href")
    return exploded_links(spark, sf_dir).select(
        "msg_id", "href",
        urls.host_of(href).alias("plain_host"),
        urls.host_of(urls.refang(href)).alias("host"),
        links.url_path(href).alias("path"),
        urls.registered_domain(urls.host_of(href)).alias("registered"),
    )


@query
def page_urls(spark, sf_dir):
    url = F.col("url")
    return demo.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.host_of(url).alias("host"),
        urls.path_of(url).alias("path"),
        F.round(urls.entropy(url), 4).alias("entropy"),
        urls.last_label(urls.host_of(url)).alias("tld"),
        dom.normalize_domain(url).alias("domain"),
    )


@query
def url_entropy(spark, sf_dir):
    return exploded_links(spark, sf_dir).select(
        "msg_id", "href", F.round(urls.entropy(F.col("href")), 4).alias("entropy")
    )


@query
def anchor_mismatch(spark, sf_dir):
    return exploded_links(spark, sf_dir).select(
        "msg_id", "href", "anchor",
        urls.anchor_mismatch(F.col("anchor"), urls.host_of(F.col("href"))).alias("mismatch"),
    )


@query
def encoded_chars(spark, sf_dir):
    return exploded_links(spark, sf_dir).select(
        "msg_id", "href", urls.encoded_characters(F.col("href")).alias("encoded"),
        (urls.percent_count(F.col("href")) > 4).alias("heavy"),
    )


@query
def ip_hosts(spark, sf_dir):
    rows = exploded_links(spark, sf_dir).withColumn("host", urls.host_of(F.col("href")))
    return rows.select("msg_id", "host", urls.is_ip_host(F.col("host")).alias("is_ip"))


@query
def suspicious_tld(spark, sf_dir):
    rows = exploded_links(spark, sf_dir).withColumn("host", urls.host_of(F.col("href")))
    member = hosts.membership_columns(F.col("host"))
    return rows.select(
        "msg_id", "host", urls.last_label(F.col("host")).alias("tld"), member["suspicious_tld"].alias("suspicious"),
        member["blocklisted"].alias("blocklisted"), member["shortener"].alias("shortener"),
    )


@query
def links_in_text(spark, sf_dir):
    rows = demo.messages(spark, sf_dir).select(
        "msg_id", F.explode(urls.urls_in_text(F.concat_ws(" ", "body_text", "links.href"))).alias("l")
    )
    return rows.groupBy("msg_id").agg(F.count("*").alias("n_links"), F.max("l.href").alias("last_link"))


# --------------------------------------------------------------- domains and hosts
@query
def normalize_domain(spark, sf_dir):
    return masked(spark, sf_dir).select(
        "msg_id",
        dom.normalize_domain(F.col("sender_email")).alias("from_address"),
        sender.sender_host(F.col("domain"), F.col("sender_email")).alias("sender_host"),
    )


@query
def subdomain_depth(spark, sf_dir):
    return distinct_hosts(spark, sf_dir).select(
        "host",
        dom.subdomain_depth(F.col("host")).cast("long").alias("depth"),
        hosts.root_label(F.col("host")).alias("root"),
        dom.has_delegated_suffix(F.col("host")).alias("delegated"),
    )


@query
def random_label(spark, sf_dir):
    parts = distinct_hosts(spark, sf_dir).select("host", F.explode(urls.labels_of(F.col("host"))).alias("label"))
    labels = parts.select("label").distinct()
    return labels.select(
        "label", dom.random_label_score(F.col("label")).alias("score"), F.round(urls.entropy(F.col("label")), 4).alias("entropy")
    )


@query
def infra_score(spark, sf_dir):
    rows = distinct_hosts(spark, sf_dir).withColumn("best", dom.best_random_label(F.col("host")))
    columns = dom.infrastructure_columns(F.col("host"), F.col("best"))
    return rows.select("host", *[c.alias(n) for n, c in columns.items()])


def _trusted(spark, sf_dir):
    return hosts.trust_and_verified(distinct_hosts(spark, sf_dir), REG)


@query
def trust_lookup(spark, sf_dir):
    return hosts.trust_and_verified(distinct_hosts(spark, sf_dir), REG, hidden=False).select(
        "host", F.col("trust.brand").alias("trust_brand"), F.col("trust.trust_type").alias("trust_type"),
        F.coalesce(F.col("trust.strong"), F.lit(False)).alias("strong_sender"),
    )


@query
def verified_brand(spark, sf_dir):
    return hosts.trust_and_verified(distinct_hosts(spark, sf_dir), REG, hidden=False).select(
        "host", F.get("verified", F.lit(0))["brand"].alias("verified_brand"),
        F.size(F.array_distinct("verified.brand")).cast("long").alias("n_brands"),
    )


@query
def brand_mentions(spark, sf_dir):
    text = sender.mention_text(F.col("display_name"), F.col("subject"))
    return masked(spark, sf_dir).select("msg_id", joined(sender.brand_mentions(text, REG)).alias("brands"))


@query
def nearest_brand(spark, sf_dir):
    return hosts.add_nearest_brand(distinct_hosts(spark, sf_dir), REG).select("host", "near_distance", "near_brand")


@query
def nearest_label(spark, sf_dir):
    rows = hosts.add_nearest_label(hosts.add_unicode_facts(distinct_hosts(spark, sf_dir)), REG)
    return rows.select("host", "skeleton", F.col("label_distance").cast("long").alias("label_distance"), "label_brand")


@query
def brand_in_subdomain(spark, sf_dir):
    rows = hosts.add_hidden_brands(_trusted(spark, sf_dir))
    return rows.filter(F.col("subdomain_brand").isNotNull()).select("host", "subdomain_brand")


@query
def embedded_brand(spark, sf_dir):
    rows = hosts.add_hidden_brands(_trusted(spark, sf_dir))
    return rows.filter(F.col("embedded_brand").isNotNull()).select("host", "embedded_brand")


@query
def brand_in_path(spark, sf_dir):
    rows = exploded_links(spark, sf_dir).withColumn("path", links.url_path(F.col("href")))
    return rows.select("msg_id", "href", links.path_brand(F.col("path"), REG).alias("path_brand"))


@query
def name_sets(spark, sf_dir):
    """Hosts by the registry's sets: verified or trusted domains, weakly trusted ones, search terms (by first label)."""
    rows = distinct_hosts(spark, sf_dir).withColumn("root", hosts.root_label(F.col("host")))
    sets = F.broadcast(REG.name_sets(spark))        # bounded with the registry
    by_host = sets.select(F.col("name").alias("host"), "domain", "trusted", "weak")
    found = rows.join(by_host, "host", "left").join(sets.where("term").select(F.col("name").alias("root"), "term"), "root", "left")
    return found.select("host", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("domain", "trusted", "weak", "term")])


@query
def trust_from_table(spark, sf_dir):
    """Trust lookups in a registry that is a table: the hosts of all pages."""
    listed = demo.table(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    kind = F.element_at(F.array(F.lit("primary"), F.lit("email"), F.lit("asset")), F.pmod(F.length("domain"), F.lit(3)) + 1)
    trust = listed.select(
        F.crc32(F.col("domain").cast("binary")).alias("position"), F.concat(F.lit("Brand of "), "domain").alias("brand"), "domain", kind.alias("trust_type"))
    registry = Registry.from_tables(trust)
    pages = listed.select(F.concat(F.lit("www."), "domain").alias("host")).union(listed).union(listed.select(F.concat(F.lit("a."), "domain")))
    rows = hosts.trust_and_verified(pages.distinct(), registry, hidden=False)
    return rows.select(
        "host", F.col("trust.brand").alias("brand"), F.col("trust.trust_type").alias("trust_type"), F.size("verified").cast("long").alias("n_verified"))


@query
def links_without_href(spark, sf_dir):
    """Messages some of whose links have no address: these don't count."""
    rows = masked(spark, sf_dir)
    dropped = F.transform("links", lambda l, i: F.struct(F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, F.lit("")).otherwise(l["href"]).alias("href"), l["anchor_text"].alias("anchor_text")))
    return links.link_features(rows.withColumn("links", dropped), REG).select("msg_id", "url_count", "url_entropy_max")


@query
def domain_lookalike(spark, sf_dir):
    rows = hosts.add_lookalike(_trusted(spark, sf_dir), REG)
    return rows.select("host", *hosts.lookalike_columns())


def _link_scores(spark, sf_dir):
    rows = masked(spark, sf_dir)
    refs = links.host_references(rows, REG)
    return links.add_link_scores(links.join_profile(refs, store(links.host_usage(rows)), REG))


@query
def url_lookalike(spark, sf_dir):
    return _link_scores(spark, sf_dir).select(
        "msg_id", "host", "url_lookalike", "path_flag", "shortener", F.round("points", 4).alias("points")
    )


@query
def sender_features(spark, sf_dir):
    return features(spark, sf_dir).select(
        "msg_id", F.col("normalized_domain").alias("sender_host"), "recognized_brand", "domain_trust_type", "punycode_detection",
        "subdomain_depth", "levenshtein_distance_to_brand", "display_name_mismatch", "domain_registry_mismatch", "likely_brand",
        "sender_domain_entropy", "random_label_score", "domain_infrastructure_score", "highest_entropy_label", "lookalike_score",
        "lookalike_brand",
    )


@query
def link_features(spark, sf_dir):
    return links.link_features(masked(spark, sf_dir), REG).select("msg_id", *links.LINK_FEATURES)


@query
def link_reputation(spark, sf_dir):
    return links.link_features(masked(spark, sf_dir), REG).select(
        "msg_id", "link_points", joined("link_reasons").alias("link_reasons")
    )


@query
def structure_features(spark, sf_dir):
    return structure.add_structure(masked(spark, sf_dir)).select(
        "msg_id", "html_to_text_ratio", "form_tag_presence", "hidden_element_count"
    )


@query
def page_structure(spark, sf_dir):
    pages = demo.table(spark, sf_dir, "pages").withColumn("body_text", F.lit(""))
    return structure.add_structure(pages).select(
        "page_id", "html_to_text_ratio", "form_tag_presence", "hidden_element_count"
    )


# ---------------------------------------------------------------------- scoring
@query
def fallback_probability(spark, sf_dir):
    return features(spark, sf_dir).select("msg_id", scoring.fallback_probability().alias("ml_probability"))


@query
def feature_frame(spark, sf_dir):
    return features(spark, sf_dir).select("msg_id", *fv.NUMERIC_FEATURES)


@query
def impersonation(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "msg_id", "impersonation_score", "impersonated_brand", joined("impersonation_reasons").alias("why")
    )


@query
def domain_reputation(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_id", "domain_reputation", joined("domain_reasons").alias("why"))


@query
def reputation(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_id", "link_reputation")


@query
def assess_reasons(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_id", joined("reasons").alias("reasons"))


@query
def fused_score(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_id", "risk_score", "classification", "confidence")


@query
def assess(spark, sf_dir):
    return assessed(spark, sf_dir).select(
        "msg_id", "sample_hash", "domain", "source", "risk_score", "classification", "confidence",
        "impersonated_brand", joined("reasons").alias("reasons"), "components.*",
    )


@query
def page_assess(spark, sf_dir):
    pages = demo.table(spark, sf_dir, "pages")
    # two jobs: the pages are parsed once, then the stored messages are assessed
    envelopes = store(source.pages_to_messages(pages))
    rows = plan.assess(triage.triage(envelopes), REG, key=demo.HMAC_KEY, valid_only=False)
    return rows.select("msg_id", "domain", "risk_score", "classification", "confidence", "impersonated_brand", joined("reasons").alias("reasons"))


@query
def assessed_summary(spark, sf_dir):
    return analytics.summary(assessed(spark, sf_dir))


@query
def assessed_brands(spark, sf_dir):
    return analytics.top_brands(assessed(spark, sf_dir), 10)


@query
def event_table(spark, sf_dir):
    rows = tables.event_rows(assessed(spark, sf_dir))
    return rows.select(
        "id", "sample_hash", "sender_hash", "subject_hash", "domain", "risk_score", "classification",
        F.col("features.url_count").alias("url_count"), F.col("features.likely_brand").alias("likely_brand"),
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
    )


# ----------------------------------------------------------------------- triage
@query
def triage_keyword(spark, sf_dir):
    return triage.triage_details(demo.messages(spark, sf_dir)).select(
        "msg_id", "kw_urgency", "kw_credentials", "kw_financial", F.round("keyword_score", 4).alias("keyword_score")
    )


@query
def triage_link(spark, sf_dir):
    return triage.triage_details(demo.messages(spark, sf_dir)).select(
        "msg_id", *[F.col(f"lk.{c}").cast("long").alias(c) for c in ("mismatches", "ip", "tld", "encoded")],
        F.round("triage_link_score", 4).alias("link_score"),
    )


@query
def triage_domain(spark, sf_dir):
    return triage.triage_details(demo.messages(spark, sf_dir)).select(
        "msg_id", joined("br_mismatched").alias("brands"), "brand_score"
    )


@query
def triage_spoof(spark, sf_dir):
    return triage.triage_details(demo.messages(spark, sf_dir)).select(
        "msg_id", "sp_homoglyph", F.col("sp_terms").cast("long").alias("sp_terms"),
        F.col("sp_hyphens").cast("long").alias("sp_hyphens"), F.round("spoof_score", 4).alias("spoof_score"),
    )


@query
def triage_score(spark, sf_dir):
    return triage.triage(demo.messages(spark, sf_dir)).select(
        "msg_id", "heuristic_score", joined("client_reasons").alias("client_reasons")
    )


@query
def triage_split(spark, sf_dir):
    full, cheap = triage.split_triaged(triage.triage(demo.messages(spark, sf_dir).filter(triage.has_content())))
    return full.select("msg_id", F.lit("full").alias("route")).unionByName(
        cheap.select("msg_id", F.lit("safe").alias("route"))
    )


@query
def validate_messages(spark, sf_dir):
    rows = schemas.validate_messages(schemas.with_defaults(demo.messages(spark, sf_dir)))
    return rows.select("msg_id", joined("violations").alias("violations"))


@query
def validate_feedback(spark, sf_dir):
    rows = schemas.validate_feedback(demo.as_feedback(demo.table(spark, sf_dir, "events")))
    return rows.select("feedback_id", joined("violations").alias("violations"))


@query
def quarantined_messages(spark, sf_dir):
    _, bad = plan.checked(demo.headed_messages(spark, sf_dir))
    return bad.select("msg_id", joined("violations").alias("violations"))


@query
def assess_valid(spark, sf_dir):
    rows = plan.assess(demo.headed_messages(spark, sf_dir), REG, key=demo.HMAC_KEY)
    return rows.select("msg_id", "domain", "source")


# ------------------------------------------------------------------------ pages
@query
def page_messages(spark, sf_dir):
    pages = demo.table(spark, sf_dir, "pages")
    return source.pages_to_messages(pages).select(
        "msg_id", "sender_email", "display_name", "subject", F.md5("body_text").alias("body_md5"),
        F.size("links").cast("long").alias("n_links"), "domain",
    )


@query
def page_links(spark, sf_dir):
    pages = demo.table(spark, sf_dir, "pages")
    found = source.page_links(structure.without_unseen(F.col("html")), F.col("url"), drop_mailto=True)
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "l"))
    return rows.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("l.href").alias("href"), F.col("l.anchor_text").alias("anchor"))


@query
def page_is_mail(spark, sf_dir):
    pages = demo.table(spark, sf_dir, "pages")
    return pages.select("page_id", source.looks_like_mail(F.col("html"), F.col("url")).alias("is_mail"))


@query
def longest_block(spark, sf_dir):
    pages = demo.table(spark, sf_dir, "pages").select("page_id", source.longest_block(F.col("html")).alias("block"))
    return pages.select("page_id", F.length("block").cast("long").alias("n_chars"), F.md5("block").alias("block_md5"))


# ---------------------------------------------------------------------- reports
@query
def summary(spark, sf_dir):
    return analytics.summary(demo.risk_events(spark, sf_dir))


@query
def class_share(spark, sf_dir):
    return analytics.class_share(demo.risk_events(spark, sf_dir))


@query
def daily_trend(spark, sf_dir):
    rows = analytics.daily_trend(demo.risk_events(spark, sf_dir), AS_OF, 14)
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_events", "average_risk")


@query
def top_brands(spark, sf_dir):
    return analytics.top_brands(demo.risk_events(spark, sf_dir), 10)


@query
def recent_events(spark, sf_dir):
    rows = analytics.recent_events(demo.risk_events(spark, sf_dir), 25)
    return rows.withColumn("reasons", joined("reasons"))


@query
def shown_reasons(spark, sf_dir):
    rows = demo.risk_events(spark, sf_dir)
    shown = {f"first_{n}": joined(analytics.shown_reasons("reasons", n)) for n in (1, 4)}
    return rows.select("id", *[col.alias(name) for name, col in shown.items()])


@query
def risk_points(spark, sf_dir):
    return analytics.trend_points(demo.risk_events(spark, sf_dir), 14)


@query
def normalized_points(spark, sf_dir):
    return analytics.normalized_points(demo.risk_events(spark, sf_dir).select("id", "created_at", "risk_score")).select(
        "id", "label", "risk"
    )


@query
def event_points(spark, sf_dir):
    """The newest points; every third has no time and is named by its place."""
    rows = analytics.newest(demo.risk_events(spark, sf_dir), 60).select("id", "created_at", "risk_score")
    shown = rows.select("id", F.when(F.col("id") % 3 > 0, F.col("created_at")).alias("created_at"), F.col("created_at").alias("at"), "risk_score")
    return analytics.normalized_points(shown, ["at", "id"]).select("id", "label", "risk")


@query
def last_points(spark, sf_dir):
    return analytics.last_points(demo.risk_events(spark, sf_dir))


@query
def class_events(spark, sf_dir):
    return analytics.with_class(demo.risk_events(spark, sf_dir), "phishing").select("id", "risk_score")


@query
def siem_events(spark, sf_dir):
    rows = analytics.siem_rows(demo.risk_events(spark, sf_dir))
    flat = {"event.category", "event.type", "msgrisk.reasons"}
    return rows.select(*[
        (joined(f"`{c}`") if c in flat else F.col(f"`{c}`")).alias(c.replace(".", "_")) for c in rows.columns
    ])


@query
def siem_envelope(spark, sf_dir):
    shown = F.transform("events", lambda e: F.concat_ws(" ", e["event.created"], e["event.kind"], e["msgrisk.sample_hash"]))
    return analytics.siem_envelope(demo.risk_events(spark, sf_dir), "msgrisk", 100).select(
        "schema", "format", "count", joined(F.array_sort(shown)).alias("events")
    )


@query
def rate_minute(spark, sf_dir):
    rows = analytics.rate_counts(demo.requests(spark, sf_dir), 1)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "client", "n_requests", "over_limit")


@query
def rate_clients(spark, sf_dir):
    """Requests by forwarded address, else peer, without health checks."""
    rows = demo.table(spark, sf_dir, "events")
    forwarded = F.when(F.col("event_type") == "view", F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(", 10.9.9.9")))
    peer = F.when(F.col("event_type") != "signup", F.concat(F.lit("peer"), F.col("user_id").cast("string")))
    path = F.concat(F.lit("/api/"), F.when(F.col("event_type") == "error", "health").otherwise(F.col("event_type")))
    requests = rows.select(F.col("ts").cast("timestamp").alias("ts"), analytics.client_of(forwarded, peer).alias("client"), path.alias("path"))
    counts = analytics.rate_counts(requests, 1)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "client", "n_requests", "over_limit")


@query
def message_source(spark, sf_dir):
    """Messages written as JSON without their empty columns, and read with the fixed schema and defaults."""
    work = _work(spark)
    rows = demo.messages(spark, sf_dir).drop("heuristic_score", "sender_local_category", "client_reasons")
    rows.write.json(work)
    read = source.read_messages(spark, work)
    return read.select(
        "msg_id", "subject", "source", "heuristic_score", F.size("client_reasons").cast("long").alias("n_reasons"),
        F.size("links").cast("long").alias("n_links"), F.md5("body_text").alias("body_md5"),
    )


@query
def ttl_cache(spark, sf_dir):
    return ledger.ttl_cache(demo.requests(spark, sf_dir), "client", "ts", "event_id", 21600).select("event_id", "is_hit")


@query
def cooldown(spark, sf_dir):
    return ledger.cooldown(demo.requests(spark, sf_dir), "client", "ts", "event_id", 7200).select("event_id", "accepted")


def _payloads(events: DataFrame) -> DataFrame:
    """Checks of a client, with a payload hash that often repeats."""
    payload = F.when(F.col("event_type") != "error", F.md5("event_type"))
    return events.select(F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), "event_id", payload.alias("payload"))


@query
def cooldown_hash(spark, sf_dir):
    rows = _payloads(demo.table(spark, sf_dir, "events"))
    return ledger.cooldown(rows, "client", "ts", "event_id", 7200, "payload").select("event_id", "accepted")


@query
def fresh_entries(spark, sf_dir):
    rows = ledger.fresh_entries(demo.risk_events(spark, sf_dir), "2024-01-30 12:00:00", 86400)
    return rows.select("id")


# --------------------------------------------------------------------- feedback
@query
def feedback_first(spark, sf_dir):
    return fb.first_feedback(demo.feedback(spark, sf_dir)).select("sample_hash", "user_feedback", "feedback_id", "current_risk_score")


@query
def feedback_new(spark, sf_dir):
    """Second half of the month against the stored first half."""
    rows = demo.feedback(spark, sf_dir)
    stored = fb.first_feedback(rows.filter(F.col("created_at") < F.lit("2024-01-16").cast("timestamp")))
    later = rows.filter(F.col("created_at") >= F.lit("2024-01-16").cast("timestamp"))
    return fb.new_feedback(later, stored).select("sample_hash", "user_feedback", "feedback_id", "review_status")


@query
def recent_feedback(spark, sf_dir):
    rows = fb.first_feedback(demo.feedback(spark, sf_dir)).withColumn("review_status", F.lit("pending"))
    return analytics.feedback_queue(rows, 50).select("feedback_id", "sample_hash", "feedback_label", "review_status", "created_at")


# ------------------------------------------------------------------- rules, feeds
@query
def rule_hits(spark, sf_dir):
    rows = plan.extract_features(masked(spark, sf_dir), REG, training.TextPassThrough())
    flags = {c: F.col(c) for c in ("display_name_mismatch", "domain_registry_mismatch", "anchor_mismatch_flag", "punycode_detection")}
    flags["homoglyph"] = F.when(dom.has_homoglyph(F.col("normalized_domain")), 1.0).otherwise(0.0)
    return rules.rule_hits(rows, "model_text", flags).select("msg_id", "rule_id", "severity")


def _feed(spark, sf_dir):
    """Message links as feed records: source of the message, time by id."""
    rows = demo.messages(spark, sf_dir).select("msg_id", "source", "received_at", F.explode("links.href").alias("url"))
    return rows.select("url", F.upper("source").alias("source"), F.col("received_at").alias("first_seen"), F.lit(0.5).alias("confidence"))


@query
def feed_normalize(spark, sf_dir):
    return feeds.normalize_feed(_feed(spark, sf_dir)).select(
        "url", "domain", "source", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "confidence"
    )


@query
def indicator_expiry(spark, sf_dir):
    feed = feeds.normalize_feed(_feed(spark, sf_dir))
    return feeds.live_indicators(feed, {"gmail": 1, "generic": 2, "outlook": 3}, "2024-01-04 00:00:00", 4).select("url", "source")


@query
def known_links(spark, sf_dir):
    """Message links whose host two of the feed's sources had listed, a day after they were first sent, and not too long ago."""
    feed = feeds.normalize_feed(_feed(spark, sf_dir)).where("source <> 'generic'").withColumn("first_seen", F.col("first_seen") + F.expr("INTERVAL 1 DAY"))
    lifetimes = spark.createDataFrame([("gmail", 1)], "source string, days int")
    rows = demo.messages(spark, sf_dir).select("msg_id", F.col("received_at").alias("seen_at"), F.posexplode("links.href").alias("place", "href"))
    rows = rows.withColumn("host", urls.host_of(F.col("href")))
    return feeds.known_links(rows, feed, lifetimes, 2).select("msg_id", F.col("place").cast("long").alias("place"), "host", joined("known_by").alias("known_by"))


# --------------------------------------------------------------------- learning
@query
def training_csv(spark, sf_dir):
    """Labelled texts, with line breaks and quotes, written as CSV and read as training messages."""
    work = _work(spark)
    rows = demo.labelled(spark, sf_dir).select("doc_id", "text", F.when(F.col("label") == 1, "phishing").otherwise("ham").alias("label"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(work)
    read = source.training_messages(source.read_training_csv(spark, work), "doc_id")
    return read.select(F.col("msg_id").cast("long").alias("doc_id"), "label", F.md5("body_text").alias("text_md5"))


@query
def threshold_fpr(spark, sf_dir):
    return learning.operating_point(_predictions(spark, sf_dir), 0.2)


@query
def label_normalize(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "labels")
    return rows.select(
        "doc_id", source.normalize_label(F.col("toxic")).alias("toxic"),
        source.normalize_label(F.when(F.col("quality") == 1, " Safe ").otherwise("PHISH")).alias("label"),
    )


@query
def class_weights(spark, sf_dir):
    return learning.class_weights(demo.labelled(spark, sf_dir))


@query
def deduplicated_texts(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "documents").select("doc_id", "text")
    return source.deduplicate_texts(rows, "text", "doc_id").select("doc_id")


def _terms(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("w", learning.words(F.col("text"))).select(
        "doc_id", learning.words_and_pairs(F.col("w")).alias("terms")
    )


@query
def ngram_vocab(spark, sf_dir):
    return learning.vocabulary(_terms(spark, sf_dir), "terms").select("term", "n_total", "n_docs")


@query
def stratified_split(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return learning.stratified_split(rows, "label", "doc_id").select("doc_id", "label", "is_test")


def _predictions(spark, sf_dir):
    """Document length as a score for the quality label."""
    labels = demo.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = demo.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = F.round(F.least(F.col("n_chars") / 5000, F.lit(1.0)), 3)
    return docs.join(labels, "doc_id").select("doc_id", "label", score.alias("score"), (score >= 0.3).cast("int").alias("prediction"))


@query
def confusion_matrix(spark, sf_dir):
    counts = learning.confusion(_predictions(spark, sf_dir))
    return counts.select("tp", "fp", "fn", "tn", F.round(F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)), 4).alias("fpr"))


@query
def eval_report(spark, sf_dir):
    return learning.evaluation_report(_predictions(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    return learning.roc_auc(_predictions(spark, sf_dir))


@query
def scale_stats(spark, sf_dir):
    return learning.scale_statistics(_text(spark, sf_dir), ["word_count", "unique_word_ratio", "uppercase_ratio"])


@query
def training_frame(spark, sf_dir):
    rows = source.training_messages(demo.labelled(spark, sf_dir), "doc_id")
    frame = training.training_frame(rows, REG)
    return frame.select("msg_id", "label", F.md5("text").alias("text_md5"), "word_count", "url_count", "levenshtein_distance_to_brand")


def _training_frame(spark, sf_dir):
    labelled = source.deduplicate_texts(demo.labelled(spark, sf_dir), "text", "doc_id")
    return store(training.training_frame(source.training_messages(labelled, "doc_id"), REG))


@query
def ml_train_score(spark, sf_dir):
    model, metrics, predictions = training.train_model(_training_frame(spark, sf_dir))
    return training.model_run_row(spark, metrics, model.version)


@query
def model_comparison(spark, sf_dir):
    return training.compare_models(_training_frame(spark, sf_dir))


# -------------------------------------------------------------------- streaming
def _work(spark) -> str:
    return f"{checkpoint_root(spark)}/job-{uuid.uuid4().hex}"


def _arriving(spark, sf_dir, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files.

    A stream's path must be a folder unless it is a pattern; this one matches the table alone."""
    schema = demo.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _event_stream(spark, sf_dir):
    return _arriving(spark, sf_dir, "events")


@query
def stream_rate(spark, sf_dir):
    work = _work(spark)
    rows = _event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("client")
    )
    jobs.rate_stream(rows, f"{work}/out", f"{work}/progress", 1).awaitTermination()
    out = jobs.read_rates(spark, f"{work}/out")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "client", "n_requests", "over_limit")


@query
def stream_dedup(spark, sf_dir):
    work = _work(spark)
    rows = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id")
    kept = jobs.deduplicate_stream(rows, "user_id", "ts", "event_id")
    writer = kept.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("key string, row_id long, ts timestamp").parquet(f"{work}/out")
    return out.select(F.col("row_id").alias("event_id"), F.col("key").cast("long").alias("user_id"))


def _marked(spark, marks: DataFrame, name: str) -> DataFrame:
    work = _work(spark)
    writer = marks.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/progress")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(jobs.WindowProcessor.OUTPUT).parquet(f"{work}/out")
    return rows.select(F.col("row_id").alias("event_id"), F.col("accepted").alias(name))


@query
def stream_cooldown(spark, sf_dir):
    return _marked(spark, jobs.cooldown_stream(_event_stream(spark, sf_dir), "user_id", "ts", "event_id", 7200, 14400), "accepted")


@query
def stream_cooldown_hash(spark, sf_dir):
    rows = _payloads(_event_stream(spark, sf_dir))
    return _marked(spark, jobs.cooldown_stream(rows, "client", "ts", "event_id", 7200, 40 * 86400, payload="payload"), "accepted")


@query
def stream_late(spark, sf_dir):
    """Events that arrive type by type: each type's own batch comes after whole other ones."""
    work = _work(spark)
    events = demo.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    kinds = [r["event_type"] for r in events.select("event_type").distinct().orderBy("event_type").collect()]      # a handful
    for kind in kinds:
        events.where(F.col("event_type") == kind).coalesce(1).write.mode("append").parquet(f"{work}/arriving")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/arriving")
    jobs.late_stream(arriving, f"{work}/out", f"{work}/progress", "10 days").awaitTermination()
    return jobs.read_late(spark, f"{work}/out").select("event_id", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss.SSS").alias("watermark"))


@query
def stream_ttl(spark, sf_dir):
    rows = _marked(spark, jobs.ttl_stream(_event_stream(spark, sf_dir), "user_id", "ts", "event_id", 21600), "accepted")
    return rows.select("event_id", (~F.col("accepted")).alias("is_hit"))


@query
def stream_feedback(spark, sf_dir):
    work = _work(spark)
    arriving = demo.as_feedback(_event_stream(spark, sf_dir))
    jobs.feedback_stream(arriving, f"{work}/out", f"{work}/progress").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("sample_hash", "user_feedback", "feedback_id", "review_status")


@query
def stream_dashboard(spark, sf_dir):
    work = _work(spark)
    feedback = demo.as_feedback(_event_stream(spark, sf_dir))
    jobs.feedback_stream(feedback, f"{work}/feedback", f"{work}/progress/feedback", panels_path=f"{work}/panels").awaitTermination()
    arriving = demo.as_risk_events(_event_stream(spark, sf_dir))
    jobs.dashboard_stream(arriving, f"{work}/events", f"{work}/panels", f"{work}/progress/events", {"availableNow": True}).awaitTermination()
    return jobs.latest_panels(spark, f"{work}/panels", AS_OF)


@query
def stream_export(spark, sf_dir):
    work = _work(spark)
    arriving = demo.as_risk_events(_event_stream(spark, sf_dir))
    jobs.export_stream(arriving, f"{work}/out", f"{work}/progress").awaitTermination()
    rows = spark.read.schema("`event.kind` string, `event.created` string, `msgrisk.sample_hash` string, `msgrisk.risk_score` double").json(f"{work}/out")
    return rows.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in ("event.kind", "event.created", "msgrisk.sample_hash", "msgrisk.risk_score")])


@query
def stream_assess(spark, sf_dir):
    work = _work(spark)
    envelopes = triage.triage(demo.as_messages(_arriving(spark, sf_dir, "documents")))
    jobs.assess_stream(envelopes, f"{work}/out", f"{work}/progress", REG, key=demo.HMAC_KEY, valid_only=False).awaitTermination()
    return tables.read_events(spark, f"{work}/out").select("id", "sample_hash", "domain", "risk_score", "classification", "confidence", joined("reasons").alias("reasons"))
