"""Everything that depends on a host only, computed once per distinct host.

A few hosts carry most links, so the searches against the registry run on the
distinct hosts and the result (the host profile) is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions import domains as dom
from msgrisk.functions.text import bind, flag
from msgrisk.functions.urls import is_ip_host, labels_of, last_label
from msgrisk.operators import names
from msgrisk.registry import Registry, constant_table


_PIECE = "array<struct<kind:string,key:string,cut:int,suffix:boolean,label:string>>"


def _label_runs(parts: Column, least: int, most: int) -> Column:
    """Runs of ``least`` to ``most`` labels; ``cut`` counts the labels before one, ``suffix`` tells that none follows."""
    n = F.size(parts)

    def from_place(i: Column) -> Column:
        lengths = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: i + k <= n)
        return F.transform(
            lengths,
            lambda k: F.struct(
                F.lit("name").alias("kind"), F.array_join(F.slice(parts, i + 1, k), ".").alias("key"), i.alias("cut"),
                (i + k == n).alias("suffix"), F.lit("").alias("label"),
            ),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_place))


def _label_grams(host: Column) -> Column:
    """The character runs of the labels in which a brand label may be embedded: all but the last two."""
    parts = labels_of(host)
    candidates = F.when(F.size(parts) > 2, F.slice(parts, 1, F.size(parts) - 2)).otherwise(F.slice(parts, 1, 1))

    def of_label(label: Column) -> Column:
        return F.transform(
            names.grams_of(label),
            lambda g: F.struct(F.lit("gram").alias("kind"), g.alias("key"), F.lit(0).alias("cut"), F.lit(False).alias("suffix"), label.alias("label")),
        )

    return F.flatten(F.transform(F.array_distinct(candidates), of_label))


def host_index(spark: SparkSession, registry: Registry) -> DataFrame:
    """(kind, key, trust, brands, terms): the registry by its domains, and by the rarest character run of its longer labels."""
    rows = [
        ("name", domain, None if domain not in registry.trust else (*registry.trust[domain], registry.trust[domain][1] in fv.STRONG_TRUST_TYPES),
         [(t.position, t.brand) for t in registry.by_domain().get(domain, [])], [])
        for domain in dict.fromkeys([*registry.trust, *registry.by_domain()])
    ]
    rows += [("gram", gram, None, [], [(t.position, t.brand, t.term) for t in terms]) for gram, terms in names.rarest_grams(registry.labels).items()]
    return constant_table(
        spark, rows, "kind string, key string, trust struct<brand:string,trust_type:string,strong:boolean>, "
        "brands array<struct<position:int,brand:string>>, terms array<struct<position:int,brand:string,term:string>>",
    )


def trust_and_verified(hosts: DataFrame, registry: Registry, hidden: bool = True) -> DataFrame:
    """Add to distinct hosts the trust record (``trust``, longest suffix wins), the brands each is verified for
    (``verified``, in registry order) and, if ``hidden``, the first brand with a verified domain inside the host
    (``inner``) and the first with its label inside one of the host's labels (``embedded``), as struct(position, brand).

    All four are one equality join: of the host's label runs with the registry's domains, and of the character
    runs of its labels with the rarest run of each brand label, where the match is verified.  The pieces of a host
    sit in one task, so grouping them again combines to one row per host before anything is shuffled; other
    columns of ``hosts`` ride along instead of being joined back.
    """
    others = [F.max(c).alias(c) for c in hosts.columns if c != "host"]
    sizes = [domain.count(".") + 1 for domain in [*registry.trust, *registry.by_domain()]]
    runs = bind(F.split("host", r"\."), lambda parts: _label_runs(parts, min(sizes), max(sizes)))
    if hidden:
        pieces = F.concat(runs.cast(_PIECE), _label_grams(F.col("host")).cast(_PIECE))
    else:
        pieces = F.filter(runs, lambda p: p["suffix"])
    # the registry is bounded in rows and bytes where it is read
    index = F.broadcast(host_index(hosts.sparkSession, registry))
    rows = hosts.select("*", F.explode_outer(pieces).alias("piece")).select(*hosts.columns, "piece.*")
    matched = rows.join(index, ["kind", "key"], "left")
    # the trust lookup drops a leading www label, the brand lookup keeps it
    www = (F.col("cut") == 0) & F.startswith("host", F.lit("www."))
    found = [
        *others,
        F.min_by("trust", F.when(F.col("suffix") & ~www & F.col("trust").isNotNull(), F.col("cut"))).alias("trust"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("suffix"), F.col("brands"))))).alias("verified"),
    ]
    if hidden:
        inside = F.filter("terms", lambda t: F.contains("label", t["term"]) & (F.col("label") != t["term"]))
        first = F.array_min(F.transform(inside, lambda t: F.struct(t["position"].alias("position"), t["brand"].alias("brand"))))
        found += [
            F.min(F.when((F.col("kind") == "name") & ~F.col("suffix"), F.array_min("brands"))).alias("inner"),
            F.min(F.when(F.col("kind") == "gram", first)).alias("embedded"),
        ]
    return matched.groupBy("host").agg(*found)


def compact_label(host: Column) -> Column:
    """First label without hyphens, the form compared with brand names."""
    return F.replace(F.substring_index(host, ".", 1), F.lit("-"), F.lit(""))


def root_label(host: Column) -> Column:
    return F.coalesce(F.get(labels_of(host), F.lit(0)), F.lit(""))


def add_nearest_brand(hosts: DataFrame, registry: Registry, wanted: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """``near_distance`` (share of the label length) and ``near_brand`` of the ``wanted`` hosts.

    ``source`` may give the same hosts in a shorter way than ``hosts`` does."""
    label = compact_label(F.col("host"))
    sought = label if wanted is None else F.when(wanted, label)
    texts = None if source is None else source.select(sought.alias("text"))
    found = names.add_nearest(hosts, "_near", sought, registry.aliases, texts)
    share = F.round(F.col("_near")["distance"] / F.greatest(F.length(label), F.lit(1)), 4)
    nameless = F.col("host") == ""      # no name, no neighbour: distance 1, no brand
    return found.withColumns(
        {
            "near_distance": F.when(nameless, F.lit(1.0)).otherwise(share),
            "near_brand": F.when(~nameless, F.col("_near")["brand"]),
        }
    ).drop("_near")


def add_unicode_facts(hosts: DataFrame) -> DataFrame:
    """``skeleton`` of the first label and ``mixed_script``; Python only for non-ASCII."""
    odd = F.when(dom.is_non_ascii(F.col("host")), F.col("host"))
    facts = hosts.withColumn("_facts", dom.unicode_facts(odd))
    label = F.coalesce(F.col("_facts")["folded"], root_label(F.col("host")))
    return facts.withColumns(
        {
            "skeleton": dom.skeleton(label),
            "mixed_script": F.coalesce(F.col("_facts")["mixed"], F.lit(False)),
        }
    ).drop("_facts")


def add_nearest_label(hosts: DataFrame, registry: Registry, source: DataFrame | None = None) -> DataFrame:
    """``label_distance`` and ``label_brand``: verified label nearest to the skeleton."""
    texts = None if source is None else add_unicode_facts(source.select("host")).select(F.col("skeleton").alias("text"))
    found = names.add_nearest(hosts, "_label", F.col("skeleton"), registry.labels, texts)
    return found.withColumns(
        {"label_distance": F.col("_label")["distance"], "label_brand": F.col("_label")["brand"]}
    ).drop("_label")


def add_hidden_brands(hosts: DataFrame) -> DataFrame:
    """``subdomain_brand`` and ``embedded_brand`` of untrusted hosts (needs ``trust_and_verified``)."""
    untrusted = F.col("trust").isNull()
    return hosts.withColumns(
        {
            "subdomain_brand": F.when(untrusted, F.col("inner")["brand"]),
            "embedded_brand": F.when(untrusted, F.col("embedded")["brand"]),
        }
    )


def lookalike_columns() -> dict[str, Column]:
    """The seven look-alike columns from the searches above."""
    host = F.col("host")
    distance = F.col("label_distance")
    label_length = F.length(root_label(host))
    unverified = F.col("label_brand").isNotNull() & ~F.exists(
        "verified", lambda v: v["brand"] == F.col("label_brand")
    )
    homograph = dom.is_non_ascii(host) & (distance <= 1) & unverified
    typosquat = (
        unverified
        & (label_length >= 5)
        & (distance > 0)
        & (distance <= F.when(label_length >= 8, 2).otherwise(1))
    )
    in_subdomain = F.col("subdomain_brand").isNotNull()
    embedded = F.col("embedded_brand").isNotNull()
    hyphenated = (
        F.contains(host, F.lit("-"))
        & F.col("trust").isNull()
        & (embedded | (unverified & dom.contains_any(host, fv.SPOOF_TERMS)))
    )
    parts = [
        (homograph, 0.45), (F.col("mixed_script"), 0.20), (typosquat, 0.35), (in_subdomain, 0.45),
        (embedded, 0.30), (hyphenated, 0.25), (F.contains(host, F.lit("xn--")), 0.30),
    ]
    score = F.lit(0.0)
    for condition, points in parts:
        score = score + F.when(condition, points).otherwise(0.0)
    brand = F.coalesce("embedded_brand", "subdomain_brand", "label_brand")
    return {
        "lookalike_score": F.round(F.least(score, F.lit(1.0)), 4),
        "homograph_flag": flag(homograph),
        "mixed_script_flag": flag(F.col("mixed_script")),
        "typosquat_flag": flag(typosquat),
        "brand_in_subdomain_flag": flag(in_subdomain | embedded),
        "suspicious_hyphenated_brand_flag": flag(hyphenated),
        "lookalike_brand": F.when(score > 0, brand),
    }


def add_lookalike(hosts: DataFrame, registry: Registry, source: DataFrame | None = None) -> DataFrame:
    """Look-alike columns for distinct hosts that already carry what ``trust_and_verified`` adds."""
    found = add_nearest_label(add_unicode_facts(hosts), registry, source)
    return add_hidden_brands(found).withColumns(lookalike_columns())


PROFILE_COLUMNS = [
    "trust_brand", "trust_type", "strong_sender", "verified_brand", "near_distance", "near_brand",
    "lookalike_score", "homograph_flag", "mixed_script_flag", "typosquat_flag",
    "brand_in_subdomain_flag", "suspicious_hyphenated_brand_flag", "lookalike_brand",
    "sender_domain_entropy", "random_label_score", "random_subdomain_flag",
    "suspicious_delegated_suffix_flag", "domain_infrastructure_score", "highest_entropy_label",
]


def host_profile(hosts: DataFrame, registry: Registry) -> DataFrame:
    """One row per distinct host with all registry lookups and name statistics.

    ``hosts`` has one row per host (column ``host``) and may carry ``is_sender``;
    the sender-only columns stay null for hosts never used as a sender domain.
    """
    sender = F.col("is_sender") if "is_sender" in hosts.columns else F.lit(True)
    extra = [c for c in hosts.columns if c != "host"]
    # Few bytes, but much work: what needs the host alone is done in parts whose number doesn't follow their bytes,
    # before the joins with the nearest names shuffle the rows.
    hosts = names.spread(hosts, "host")
    looked_up = trust_and_verified(hosts, registry)
    best = looked_up.withColumn("_best", F.when(sender, dom.best_random_label(F.col("host"))))
    infra = {
        name: F.when(sender, col)
        for name, col in dom.infrastructure_columns(F.col("host"), F.col("_best")).items()
    }
    near = add_nearest_brand(add_lookalike(best.withColumns(infra), registry, hosts), registry, sender, hosts)
    return near.withColumns(
        {
            "trust_brand": F.col("trust")["brand"],
            "trust_type": F.col("trust")["trust_type"],
            "strong_sender": F.coalesce(F.col("trust")["strong"], F.lit(False)),
            "verified_brand": F.get("verified", F.lit(0))["brand"],
        }
    ).select("host", *extra, *PROFILE_COLUMNS)


def membership_columns(host: Column) -> dict[str, Column]:
    """Set tests on a host: blocklist, shortener, IP literal, suspicious TLD."""
    return {
        "blocklisted": host.isin(fv.BLOCKLIST),
        "shortener": host.isin(fv.SHORTENERS),
        "ip_host": is_ip_host(host),
        "suspicious_tld": last_label(host).isin(fv.SUSPICIOUS_TLDS),
    }
