"""URL and host expressions.  Hosts are cut out by pattern, not by a URL parser,
because a strict parser rejects exactly the malformed hosts worth looking at."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from msgrisk import fixed_values as fv

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_HOST = _SCHEME + r"(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
_AFTER_HOST = _SCHEME + r"[^/?#]*([^?#]*)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
# Eight groups of hex digits, or at most seven around one '::'; an IPv4 tail counts as two.
_GROUP = "[0-9a-f]{1,4}"
_TAIL = rf"(?:{_GROUP}:{_GROUP}|{_IPV4})"
_AT_MOST_SEVEN = rf"(?!(?::*{_GROUP}(?![0-9a-f])){{8}})(?!(?::*{_GROUP}:){{6}}:*[0-9]+\.)"
_IPV6 = (
    rf"^(?=[^%]*:)(?:(?:{_GROUP}:){{6}}{_TAIL}"
    rf"|{_AT_MOST_SEVEN}(?:{_GROUP}(?::{_GROUP})*)?::(?:(?:{_GROUP}:)*(?:{_IPV4}|{_GROUP}))?)(?:%.+)?$"
)


def refang(col: Column) -> Column:
    """Undo the usual disguises: hxxp schemes and bracketed dots."""
    value = F.coalesce(col, F.lit(""))
    value = F.regexp_replace(value, r"(?i)\bhxxps://", "https://")
    value = F.regexp_replace(value, r"(?i)\bhxxp://", "http://")
    return F.regexp_replace(value, fv.DEFANGED_DOT_PATTERN, ".")


def with_scheme(col: Column) -> Column:
    value = F.coalesce(col, F.lit(""))
    return F.when(F.contains(value, F.lit("://")), value).otherwise(F.concat(F.lit("https://"), value))


def host_of(col: Column) -> Column:
    """Lower-case host of a URL; '' when there is none."""
    raw = F.regexp_extract(with_scheme(col), _HOST, 1)
    return F.btrim(F.lower(F.btrim(raw, F.lit("[]"))), F.lit("."))


def path_of(col: Column) -> Column:
    """Path of a URL without query, fragment and trailing parameters."""
    url = with_scheme(col)
    path = F.when(url.rlike(_SCHEME), F.regexp_extract(url, _AFTER_HOST, 1)).otherwise(
        F.regexp_extract(url, r"^[^?#]*", 0)
    )
    return F.regexp_replace(path, r";[^/]*$", "")


def labels_of(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda part: part != "")


def last_label(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def registered_domain(host: Column) -> Column:
    """The last two labels (the whole host when it has no more)."""
    parts = labels_of(host)
    return F.when(F.size(parts) <= 2, host).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


def is_ip_host(host: Column) -> Column:
    """IPv4 or IPv6 literal (brackets already removed)."""
    return host.rlike(f"^{_IPV4}$") | host.rlike(_IPV6)


def entropy(col: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string."""
    length = F.length(col)

    def add(total: Column, char: Column) -> Column:
        share = (length - F.length(F.replace(col, char, F.lit("")))) / length
        return total - share * F.log2(share)

    chars = F.array_sort(F.filter(F.array_distinct(F.split(col, "")), lambda c: c != ""))
    return F.when(length > 0, F.aggregate(chars, F.lit(0.0), add)).otherwise(F.lit(0.0))


def percent_count(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("%"), F.lit("")))


def encoded_characters(col: Column) -> Column:
    """Characters saved by percent-decoding plus the number of percent signs."""
    safe = F.replace(
        F.regexp_replace(col, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")
    )
    decoded = F.coalesce(F.length(F.try_url_decode(safe)), F.length(col))
    saved = F.greatest(F.length(col) - decoded, F.lit(0))
    return F.when(F.contains(col, F.lit("%")), saved + percent_count(col)).otherwise(F.lit(0)).cast("double")


def anchor_mismatch(anchor: Column, host: Column) -> Column:
    """The anchor names at least one domain and none of them is the link's own."""
    named = F.regexp_extract_all(
        F.coalesce(anchor, F.lit("")), F.lit(fv.DOMAIN_IN_TEXT_PATTERN), F.lit(0)
    )
    own = registered_domain(host)
    foreign = F.forall(named, lambda d: registered_domain(F.lower(d)) != own)
    return (F.size(named) > 0) & foreign


def urls_in_text(col: Column) -> Column:
    """URLs of a text as links whose anchor is the URL itself."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(fv.URL_IN_TEXT_PATTERN), F.lit(0))
    return F.transform(found, lambda u: F.struct(u.alias("href"), u.alias("anchor_text")))


def domains_in_text(col: Column) -> Column:
    """Domains named in a text once it is refanged."""
    return F.regexp_extract_all(refang(col), F.lit(fv.DOMAIN_IN_TEXT_PATTERN), F.lit(0))


def first_address(col: Column) -> Column:
    return F.regexp_extract(F.coalesce(col, F.lit("")), fv.ADDRESS_PATTERN, 0)
