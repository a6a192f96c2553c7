"""Masking and hashing expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions.text import text_or_empty


def mask_pii(col: Column, cards: bool = True) -> Column:
    """Replace e-mail addresses, phone numbers, card-like numbers and long tokens.

    Texts without '@' skip the address pattern; texts without a digit followed by
    seven digits or separators can hold neither a phone nor a card number.
    """
    value = text_or_empty(col)
    value = F.when(
        F.contains(value, F.lit("@")), F.regexp_replace(value, fv.EMAIL_PATTERN, "[email]")
    ).otherwise(value)
    numbers = F.regexp_replace(value, fv.PHONE_PATTERN, "[phone]")
    if cards:
        numbers = F.regexp_replace(numbers, fv.CARD_PATTERN, "[number]")
    value = F.when(text_or_empty(col).rlike(fv.PHONE_START_PATTERN), numbers).otherwise(value)
    return F.regexp_replace(value, fv.LONG_TOKEN_PATTERN, "[token]")


def mask_address(col: Column) -> Column:
    """Hide the local part, keep the domain."""
    value = text_or_empty(col)
    masked = F.concat(F.lit("[local]@"), F.lower(F.substring_index(value, "@", -1)))
    return F.when(F.contains(value, F.lit("@")), masked).otherwise(mask_pii(value))


def local_category(col: Column) -> Column:
    """Kind of mailbox the local part names."""
    value = text_or_empty(col)
    local = F.lower(F.btrim(F.regexp_extract(value, r"(?s)^(.*)@", 1)))
    return (
        F.when(~F.contains(value, F.lit("@")), "unknown")
        .when(local.rlike(fv.NOREPLY_PATTERN), "noreply")
        .when(local.rlike(fv.NOTIFICATION_PATTERN), "notification")
        .when(local.rlike(fv.SUPPORT_PATTERN), "support")
        .otherwise("unknown")
    )


def _escape_non_ascii(json: Column) -> Column:
    r"""Write everything beyond '~' as \uXXXX, run by run."""
    runs = F.regexp_extract_all(json, F.lit(r"[\x00-\x7E]+|[^\x00-\x7E]+"), F.lit(0))

    def escape(run: Column) -> Column:
        units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        return F.when(run.rlike(r"^[\x00-\x7E]"), run).otherwise(
            F.regexp_replace(units, "(.{4})", r"\\u$1")
        )

    return F.when(json.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(runs, escape), "")).otherwise(json)


def canonical_json(sender: Column, subject: Column, body: Column, links: Column) -> Column:
    """Sorted-key compact JSON of the identifying fields, in plain ASCII."""
    ordered = F.transform(
        links, lambda l: F.struct(l["anchor_text"].alias("anchor_text"), l["href"].alias("href"))
    )
    record = F.struct(
        body.alias("body_text"),
        ordered.alias("links"),
        sender.alias("sender_email"),
        subject.alias("subject"),
    )
    return _escape_non_ascii(F.to_json(record, {"ignoreNullFields": "false"}))


def canonical_hash(sender: Column, subject: Column, body: Column, links: Column) -> Column:
    return F.sha2(canonical_json(sender, subject, body, links), 256)


def hmac_sha256(col: Column, key: str) -> Column:
    """Keyed hash of a text.  Take the key from configuration, never from code."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    message = F.encode(text_or_empty(col), "UTF-8")
    digest = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.sha2(F.concat(outer, digest), 256)
