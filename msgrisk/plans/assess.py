"""End-to-end assessment of a message table.

Shape of the job: the message bodies are read once, by narrow expressions only,
and are gone before the first shuffle.  What is shuffled is the feature row of a
message and its host references.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions import privacy, scoring
from msgrisk.functions.structure import add_structure
from msgrisk.functions.text import add_text_features
from msgrisk.operators import links as link_ops
from msgrisk.operators import sender as sender_ops
from msgrisk.operators.hosts import PROFILE_COLUMNS
from msgrisk.registry import Registry
from msgrisk.schemas import split_valid, validate_messages, with_defaults
from msgrisk.session import store

_NO_REASONS = "cast(array() as array<string>)"


class Model(Protocol):
    """A probability model: ``prepare`` reads ``text`` before it is dropped,
    ``predict`` adds ``ml_probability`` once all features are there."""

    version: str

    def prepare(self, df: DataFrame) -> DataFrame: ...

    def predict(self, df: DataFrame) -> DataFrame: ...


class FallbackModel:
    version = fv.FALLBACK_VERSION

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("ml_probability", scoring.fallback_probability())


class FunctionModel:
    """Any function that adds ``ml_probability`` to the feature table."""

    def __init__(self, function: Callable[[DataFrame], DataFrame], version: str = "custom"):
        self.function, self.version = function, version

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        return self.function(df)


def add_hashes(messages: DataFrame, key: str) -> DataFrame:
    """Content hash of the raw message and keyed hashes of sender and subject."""
    return messages.withColumns(
        {
            "sample_hash": privacy.canonical_hash(
                F.col("sender_email"), F.col("subject"), F.col("body_text"), F.col("links")
            ),
            "sender_hash": privacy.hmac_sha256(F.col("sender_email"), key),
            "subject_hash": privacy.hmac_sha256(F.col("subject"), key),
        }
    )


def mask_messages(messages: DataFrame) -> DataFrame:
    """Mask the personal fields; derive the mailbox category where it is missing."""

    def mask_link(link: Column) -> Column:
        href = F.coalesce(link["href"], F.lit(""))
        return F.struct(href.alias("href"), privacy.mask_pii(link["anchor_text"]).alias("anchor_text"))

    given = F.when(F.col("sender_local_category") != "", F.col("sender_local_category"))
    return messages.withColumns(
        {
            "sender_local_category": F.coalesce(given, privacy.local_category(F.col("sender_email"))),
            "sender_email": privacy.mask_address(F.col("sender_email")),
            "display_name": privacy.mask_pii(F.col("display_name")),
            "subject": privacy.mask_pii(F.col("subject")),
            "body_text": privacy.mask_pii(F.col("body_text")),
            "links": F.transform(F.filter("links", lambda l: l.isNotNull()), mask_link),
        }
    )


def message_features(masked: DataFrame, registry: Registry, model: Model) -> DataFrame:
    """All features that need the message alone; bodies and HTML are dropped here."""
    named = add_structure(masked).withColumn(
        "normalized_domain", sender_ops.sender_host(F.col("domain"), F.col("sender_email"))
    )
    featured = model.prepare(add_text_features(named)).drop("text", "body_text", "html")
    narrow = sender_ops.mention_text(F.col("display_name"), F.col("subject"))
    wide = sender_ops.mention_text(F.col("display_name"), F.col("subject"), F.col("normalized_domain"))
    mentioned = sender_ops.add_first_mentions(featured, {"mention": narrow, "wide_mention": wide}, registry)
    return mentioned.drop("display_name", "subject", "sender_email", "links")


def reference_features(masked: DataFrame, registry: Registry) -> DataFrame:
    """Link features and the sender-domain profile, one row per message.

    The distinct hosts with their counts are stored first (one pass over the link
    columns): the profile, the busiest hosts and both sides of the join read them.
    """
    host = sender_ops.sender_host(F.col("domain"), F.col("sender_email"))
    refs = link_ops.host_references(masked, registry, sender_host=host)
    usage = store(link_ops.host_usage(masked, sender_host=host))
    scored = link_ops.add_link_scores(link_ops.join_profile(refs, usage, registry))
    profile = F.max(F.when(F.col("is_sender"), F.struct(*PROFILE_COLUMNS))).alias("profile")
    per_message = scored.groupBy("msg_id").agg(profile, F.count_if("is_sender").alias("n_rows"), *link_ops.link_aggregates())
    repeated = F.raise_error(F.concat(F.lit("repeated msg_id: "), F.col("msg_id").cast("string")))
    per_message = per_message.withColumn("msg_id", F.when(F.col("n_rows") == 1, F.col("msg_id")).otherwise(repeated))
    others = [c for c in per_message.columns if c not in ("profile", "n_rows")]
    return per_message.select(*others, "profile.*")


def extract_features(masked: DataFrame, registry: Registry, model: Model | None = None) -> DataFrame:
    """All 43 numeric features and the lookup results of already masked messages."""
    own = message_features(masked, registry, model or FallbackModel())
    joined = own.join(reference_features(masked, registry), "msg_id")
    featured = joined.withColumns(sender_ops.sender_columns())
    # a model takes numbers only: what is missing counts as 0
    return featured.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in fv.NUMERIC_FEATURES})


def score_features(features: DataFrame, model: Model | None = None) -> DataFrame:
    """Probability, impersonation, reputation, reasons, risk, class and confidence."""
    model = model or FallbackModel()
    scored = model.predict(features).withColumns(
        {**sender_ops.impersonation_columns(), **sender_ops.domain_reputation_columns()}
    )
    scored = scored.withColumn(
        "link_reputation", F.round(F.greatest("link_points", "domain_reputation"), 4)
    ).withColumn(
        "reasons",
        F.concat(
            "client_reasons",
            "impersonation_reasons",
            F.coalesce("link_reasons", F.expr(_NO_REASONS)),
            "domain_reasons",
            scoring.assessment_reasons(),
        ),
    )
    scored = scored.withColumn(
        "risk_score",
        scoring.fused_score(
            F.col("ml_probability"), F.col("impersonation_score"), F.col("heuristic_score"),
            F.col("link_reputation"), F.col("domain_registry_mismatch"), F.col("reasons"),
            F.col("recognized_brand").isNotNull(), F.col("sender_local_category"),
        ),
    )
    return scored.withColumns(
        {
            "reasons": sender_ops.sorted_union(F.col("reasons")),
            "classification": scoring.classification(F.col("risk_score")),
            "confidence": scoring.confidence(F.col("risk_score")),
            "model_version": F.lit(model.version),
        }
    )


RESULT_COLUMNS = [
    "msg_id", "received_at", "sample_hash", "sender_hash", "subject_hash", "normalized_domain", "source",
    "risk_score", "classification", "confidence", "impersonated_brand", "reasons", "model_version",
]
COMPONENTS = [
    "ml_probability", "impersonation_score", "heuristic_score", "link_reputation", "domain_registry_mismatch",
]


def checked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) messages; the latter with ``violations``, the names of the rules they break."""
    return split_valid(validate_messages(with_defaults(messages)))


def assess(
    messages: DataFrame, registry: Registry | None = None, model: Model | None = None, key: str = "", valid_only: bool = True
) -> DataFrame:
    """Assess every valid message; ``checked`` gives the others.  A repeated ``msg_id`` stops the job.

    Without ``valid_only`` messages that break a rule are assessed like others, whole; only those without msg_id are left out.
    Returns one row per message: hashes, domain, risk, class, confidence, brand,
    reasons, a ``components`` struct and a ``features`` struct.  No raw text.
    """
    registry = registry or Registry.sample()
    if "received_at" not in messages.columns:
        messages = messages.withColumn("received_at", F.current_timestamp())
    taken = checked(messages)[0] if valid_only else with_defaults(messages)
    masked = mask_messages(add_hashes(taken, key))
    scored = score_features(extract_features(masked, registry, model), model)
    features = [
        *fv.NUMERIC_FEATURES, "recognized_brand", "domain_trust_type", "likely_brand",
        "highest_entropy_label", "lookalike_brand",
    ]
    return scored.select(
        *RESULT_COLUMNS,
        F.struct(*COMPONENTS).alias("components"),
        F.struct(*features).alias("features"),
    ).withColumnRenamed("normalized_domain", "domain")
