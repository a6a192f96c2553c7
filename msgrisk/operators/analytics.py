"""Reports over the event table: counts, trends, top lists, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from msgrisk import fixed_values as fv


def iso(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def newest(df: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """The ``limit`` newest rows, newest first; the id settles equal times."""
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return df.orderBy(F.desc("created_at"), F.desc(id_col)).limit(limit)


def summary(events: DataFrame) -> DataFrame:
    """Totals, counts per class and mean risk in one pass."""
    def of(name: str) -> Column:
        return F.count_if(F.col("classification") == name).alias(name)

    return events.agg(
        F.count("*").alias("total_events"),
        of("phishing"),
        of("suspicious"),
        of("safe"),
        F.round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 4).alias("average_risk"),
    )


def since(events: DataFrame, as_of: str, days: int, time: str = "created_at") -> DataFrame:
    """Rows not older than ``days`` before ``as_of``.

    A table written by ``write_events`` is partitioned by ``event_date``; the day
    predicate repeats the time predicate so that whole partitions are skipped.
    """
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    recent = F.col(time) >= start
    if "event_date" in events.columns:
        recent = recent & (F.col("event_date") >= F.to_date(start))
    return events.filter(recent)


def daily_trend(events: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    return (
        since(events, as_of, days)
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("n_events"), F.round(F.avg("risk_score"), 4).alias("average_risk"))
        .orderBy("day")
    )


def top_brands(events: DataFrame, limit: int = 10) -> DataFrame:
    return (
        events.filter(F.col("impersonated_brand").isNotNull())
        .groupBy(F.col("impersonated_brand").alias("brand"))
        .agg(F.count("*").alias("n_events"), F.round(F.avg("risk_score"), 4).alias("average_risk"))
        .orderBy(F.desc("n_events"), "brand")
        .limit(limit)
    )


def class_share(events: DataFrame) -> DataFrame:
    """Share of each class.  The window runs over the grouped rows, one per class."""
    counts = events.groupBy("classification").agg(F.count("*").alias("n_events"))
    total = F.greatest(F.sum("n_events").over(Window.partitionBy(F.lit(0))), F.lit(1))
    return counts.select(
        "classification", "n_events", F.round(F.col("n_events") / total, 4).alias("share")
    )


def with_class(events: DataFrame, name: str) -> DataFrame:
    return events.filter(F.col("classification") == name)


def recent_events(events: DataFrame, limit: int = 25) -> DataFrame:
    """Newest events in display form."""
    return newest(events, limit).select(
        "id", "sample_hash", "sender_hash", "subject_hash", "domain", "source", "risk_score",
        "classification", "confidence", "impersonated_brand", "reasons",
        iso("created_at").alias("created_at"),
    )


def risk_points(events: DataFrame, limit: int = 40) -> DataFrame:
    """Newest points, returned oldest first."""
    return (
        newest(events, limit)
        .orderBy("created_at", "id")
        .select("id", iso("created_at").alias("created_at"), "risk_score", "classification", "domain")
    )


def trend_points(events: DataFrame, days: int = 14) -> DataFrame:
    """Points shown for a number of days: 24 per day."""
    return risk_points(events, days * 24)


def normalized_points(points: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Risk clamped to 0..1 and a label from whichever of time or day is present, else ``Event n``.

    ``order`` gives the order that n counts in; it is for points on display, which are few.  Without it such
    points are labelled ``Event``."""
    names = points.columns

    def any_of(candidates: list[str], default: Column) -> Column:
        return F.coalesce(*[F.col(c) for c in candidates if c in names], default)

    risk = any_of(["risk_score", "average_risk"], F.lit(0.0)).cast("double")
    labels = []
    if "created_at" in names:
        labels.append(F.date_format(F.col("created_at").cast("timestamp"), "HH:mm"))
    if "day" in names:
        labels.append(F.col("day").cast("string"))
    nameless = F.lit("Event")
    if order:
        nameless = F.concat(F.lit("Event "), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("string"))
    label = F.coalesce(*labels, nameless)
    return points.select("*", label.alias("label"), F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0)).alias("risk"))


def last_points(events: DataFrame, count: int = 3) -> DataFrame:
    """The points listed below the trend: the newest ones as label and risk, oldest first."""
    rows = newest(events, count).select("id", "created_at", "risk_score")
    return normalized_points(rows, ["created_at", "id"]).orderBy("created_at", "id").select("id", "label", "risk")


def shown_reasons(col: str, count: int) -> Column:
    """The first reasons for display."""
    return F.slice(col, 1, count)


def siem_rows(events: DataFrame, prefix: str = "msgrisk", limit: int | None = None) -> DataFrame:
    """Flat dotted-key rows for a SIEM: all, or the ``limit`` newest.  ``prefix`` names the vendor fields."""
    rows = events if limit is None else newest(events, limit)
    kind = F.when(F.col("classification") != "safe", "alert").otherwise("event")
    own = [
        "sample_hash", "sender_hash", "subject_hash", "domain", "risk_score", "classification",
        "impersonated_brand", "reasons",
    ]
    return rows.select(
        kind.alias("event.kind"),
        F.array(F.lit("email"), F.lit("threat")).alias("event.category"),
        F.array(F.lit("indicator")).alias("event.type"),
        F.lit(prefix).alias("event.module"),
        iso("created_at").alias("event.created"),
        F.lit("email").alias("threat.indicator.type"),
        F.col("confidence").alias("threat.indicator.confidence"),
        *[F.col(name).alias(f"{prefix}.{name}") for name in own],
    )


def siem_envelope(events: DataFrame, prefix: str = "msgrisk", limit: int = 100) -> DataFrame:
    """One row {schema, format, count, events} of the ``limit`` newest; larger exports use ``siem_rows``."""
    rows = siem_rows(events, prefix, limit)
    fields = F.struct(*[F.col(f"`{name}`") for name in rows.columns])
    return rows.agg(
        F.lit(f"{prefix}.siem.v1").alias("schema"),
        F.lit("json").alias("format"),
        F.count("*").alias("count"),
        F.reverse(F.array_sort(F.collect_list(F.struct(F.col("`event.created`"), fields.alias("event"))))).alias("events"),
    ).withColumn("events", F.transform("events", lambda e: e["event"]))


def feedback_queue(feedback: DataFrame, limit: int = 50) -> DataFrame:
    """Newest feedback with readable labels."""
    names = F.create_map(*[F.lit(x) for pair in fv.FEEDBACK_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(names, F.col("user_feedback")), F.col("user_feedback"))
    return newest(feedback, limit, "feedback_id").select(
        "feedback_id", "sample_hash", "domain", "source", "current_risk_score", "current_classification",
        "user_feedback", "review_status", "reasons", label.alias("feedback_label"),
        iso("created_at").alias("created_at"),
    )


def rate_counts(requests: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """Requests per client and minute.  ``requests``: ts, client, and optionally path
    (health checks are left out).  Works on a stream that has a watermark, too."""
    if "path" in requests.columns:
        requests = requests.filter(~F.endswith("path", F.lit("/health")))
    counted = requests.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "client").agg(
        F.count("*").alias("n_requests")
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        "client",
        "n_requests",
        (F.col("n_requests") > limit).alias("over_limit"),
    )


def client_of(forwarded: Column, peer: Column) -> Column:
    """First forwarded-for entry, else the peer address, else 'local'."""
    source = F.coalesce(forwarded, peer, F.lit("local"))
    return F.btrim(F.substring_index(source, ",", 1))
