"""Threat-feed records in canonical form, their expiry, and the links they were known for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from msgrisk.functions.urls import host_of

FEED_COLUMNS = ["url", "domain", "brand", "first_seen", "source", "confidence"]


def normalize_feed(feed: DataFrame) -> DataFrame:
    """Canonical columns, one row per (url, source) with its earliest sighting."""
    present = set(feed.columns)

    def column(name: str, kind: str):
        return (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)

    rows = feed.select(
        F.btrim("url").alias("url"),
        column("domain", "string"),
        column("brand", "string"),
        column("first_seen", "timestamp"),
        F.lower(F.btrim("source")).alias("source"),
        column("confidence", "double"),
    )
    rows = rows.withColumn("domain", F.coalesce(F.col("domain"), host_of(F.col("url"))))
    earliest = F.min_by(F.struct("domain", "brand", "confidence"), F.struct("first_seen", "domain", "brand", "confidence"))
    return (
        rows.groupBy("url", "source")
        .agg(F.min("first_seen").alias("first_seen"), earliest.alias("e"))
        .select("url", "e.domain", "e.brand", "first_seen", "source", "e.confidence")
    )


def live_indicators(feed: DataFrame, ttl_days: dict[str, int], as_of: str, default_days: int = 30) -> DataFrame:
    """Indicators not yet expired under the lifetime of their source."""
    lifetimes = F.create_map(*[F.lit(x) for pair in ttl_days.items() for x in pair])
    days = F.coalesce(F.try_element_at(lifetimes, F.col("source")), F.lit(default_days))
    return feed.filter(F.col("first_seen") + F.make_dt_interval(days) >= F.lit(as_of).cast("timestamp"))


def live_spans(feed: DataFrame, lifetimes: DataFrame, default_days: int = 30) -> DataFrame:
    """Columns domain, spans: when each domain was a live indicator, as an array of struct(source, start, end).

    ``lifetimes`` (source, days) says how long a source's records live.  Records of a source that were first
    seen within one lifetime overlap one another, so the earliest and the latest of such a chunk of time bound
    their union: a domain with millions of records combines before the shuffle to one span for each chunk.
    """
    days = F.coalesce("days", F.lit(default_days))
    rows = feed.where(F.col("domain") != "").join(lifetimes.select("source", "days"), "source", "left")
    rows = rows.select("domain", "source", days.alias("days"), "first_seen")
    chunk = F.floor(F.unix_micros("first_seen") / (F.col("days") * 86_400_000_000)).alias("chunk")
    spans = rows.groupBy("domain", "source", "days", chunk).agg(F.min("first_seen").alias("start"), F.max("first_seen").alias("last"))
    end = (F.col("last") + F.make_dt_interval(F.col("days"))).alias("end")
    # as many spans of a domain as sources have lifetimes in the time of the feed
    return spans.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("source", "start", end))).alias("spans"))


def known_links(links: DataFrame, feed: DataFrame, lifetimes: DataFrame, default_days: int = 30) -> DataFrame:
    """``links`` (host, seen_at, any others) whose host was a live indicator when they were seen, with ``known_by``,
    the sources in order.

    An equality join on the host with one row for each domain; a host that many links share is split by adaptive
    execution, as the key is a one-to-one image that groups neither side.
    """
    spans = live_spans(feed, lifetimes, default_days).select(F.reverse("domain").alias("_key"), "spans")
    met = links.withColumn("_key", F.reverse("host")).join(spans, "_key")
    live = F.filter("spans", lambda s: (s["start"] <= F.col("seen_at")) & (F.col("seen_at") <= s["end"]))
    known = F.array_sort(F.array_distinct(F.transform(live, lambda s: s["source"])))
    return met.withColumn("known_by", known).where(F.size("known_by") > 0).drop("_key", "spans")
