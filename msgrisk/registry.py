"""Brand and domain-trust registry: the small reference tables of every lookup.

The registry is a curated table of a few hundred to a few thousand rows.  It is
read once on the driver under a hard bound of rows and bytes, because the
matching operators ship it to every task: as small tables for the equality
lookups (``operators.names`` makes its searches such lookups too), and as one
automaton for names contained in texts.  There is one plan for all sizes.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from msgrisk import fixed_values as fv

MOST_ROWS = 50_000         # a longer table is refused: it is read on the driver and shipped to every task
MOST_BYTES = 16_000_000    # of its names
SAMPLE = Path(__file__).parent / "data" / "registry.csv"


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's, sent as one Arrow table."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = [pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(len(arrow))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kind)


def _first_label(domain: str) -> str:
    return next((part for part in domain.split(".") if part), "")


@dataclass(frozen=True)
class Term:
    """One search term: the text looked for and the brand it stands for."""

    term: str
    position: int
    brand: str


@dataclass(frozen=True)
class Registry:
    trust: dict[str, tuple[str, str]]              # domain -> (brand, trust type)
    brands: dict[str, list[str]]                   # brand -> verified domains, in order
    mention_mode: str = "substring"
    aliases: list[Term] = field(default_factory=list)
    labels: list[Term] = field(default_factory=list)
    domains: list[Term] = field(default_factory=list)

    # ------------------------------------------------------------ construction
    @classmethod
    def build(cls, seed_brands, trust_rows, mention_mode: str = "substring") -> "Registry":
        """``seed_brands``: (brand, [domains]); ``trust_rows``: (brand, domain, type).

        Strong trust rows extend the verified domains of their brand; brands keep
        the order in which they are first met, which settles every tie.
        """
        if mention_mode not in ("substring", "word"):
            raise ValueError(f"unknown mention mode: {mention_mode}")
        brands: dict[str, list[str]] = {name: list(dict.fromkeys(doms)) for name, doms in seed_brands}
        trust: dict[str, tuple[str, str]] = {}
        for brand, domain, kind in trust_rows:
            domain = domain.lower()
            trust[domain] = (brand, kind)
            if kind in fv.STRONG_TRUST_TYPES and domain not in brands.setdefault(brand, []):
                brands[brand].append(domain)

        aliases, labels, domains = [], {}, []
        for position, (brand, doms) in enumerate(brands.items()):
            for alias in sorted({brand.lower(), brand.lower().replace(" ", "")}):
                aliases.append(Term(alias, position, brand))
            for domain in doms:
                domains.append(Term(domain, position, brand))
                label = _first_label(domain)
                if len(label) >= 3:
                    # a label shared by two brands keeps its place, the later brand owns it
                    labels[label] = (labels[label][0] if label in labels else len(labels), brand)
        return cls(
            trust=trust,
            brands=brands,
            mention_mode=mention_mode,
            aliases=aliases,
            labels=[Term(label, pos, brand) for label, (pos, brand) in labels.items()],
            domains=domains,
        )

    @classmethod
    def sample(cls, mention_mode: str = "substring") -> "Registry":
        """A small registry that comes with the package."""
        with SAMPLE.open(newline="") as file:
            rows = [(r["brand"], r["domain"], r["trust_type"]) for r in csv.DictReader(file)]
        return cls.build([], rows, mention_mode)

    @classmethod
    def from_tables(
        cls, trust: DataFrame, seed: DataFrame | None = None, mention_mode: str = "substring",
        most_rows: int = MOST_ROWS,
    ) -> "Registry":
        """Build from a trust table (position, brand, domain, trust_type) and an optional
        seed table (position, brand, domain); ``position`` gives the registry order.

        A table of more than ``most_rows`` rows or MOST_BYTES of names is refused."""

        def rows(df: DataFrame) -> list:
            got = df.limit(most_rows + 1).collect()
            if len(got) > most_rows:
                raise ValueError(f"registry table exceeds {most_rows} rows; it must be a curated list")
            if sum(len(r["brand"]) + len(r["domain"]) for r in got) > MOST_BYTES:
                raise ValueError(f"registry table exceeds {MOST_BYTES} bytes; it must be a curated list")
            return sorted(got, key=lambda r: r["position"])

        seeds: dict[str, list[str]] = {}
        if seed is not None:
            for row in rows(seed.select("position", "brand", F.lower("domain").alias("domain"))):
                seeds.setdefault(row["brand"], []).append(row["domain"])
        trust_rows = [
            (r["brand"], r["domain"], r["trust_type"])
            for r in rows(trust.select("position", "brand", "domain", "trust_type"))
        ]
        return cls.build(list(seeds.items()), trust_rows, mention_mode)

    # ---------------------------------------------------------------- as tables
    def trust_table(self, spark: SparkSession) -> DataFrame:
        """(domain, brand, trust_type, strong), one row per domain."""
        rows = [(domain, brand, kind, kind in fv.STRONG_TRUST_TYPES) for domain, (brand, kind) in self.trust.items()]
        return constant_table(spark, rows, "domain string, brand string, trust_type string, strong boolean")

    def verified_table(self, spark: SparkSession) -> DataFrame:
        """(domain, brands), one row per domain, its brands in registry order."""
        rows = [(domain, [(t.position, t.brand) for t in terms]) for domain, terms in self.by_domain().items()]
        return constant_table(spark, rows, "domain string, brands array<struct<position:int,brand:string>>")

    def name_sets(self, spark: SparkSession) -> DataFrame:
        """(name, domain, trusted, weak, term): each verified or trusted domain and each search term once, and the sets it is in."""
        verified = {t.term for t in self.domains}
        terms = {t.term for t in self.aliases}
        rows = [
            (name, name in verified or name in self.trust, name in self.trust,
             name in self.trust and self.trust[name][1] not in fv.STRONG_TRUST_TYPES, name in terms)
            for name in dict.fromkeys([*self.trust, *sorted(verified), *sorted(terms)])
        ]
        return constant_table(spark, rows, "name string, domain boolean, trusted boolean, weak boolean, term boolean")

    def by_domain(self) -> dict[str, list[Term]]:
        """The terms of each verified domain, in registry order."""
        found: dict[str, list[Term]] = {}
        for term in self.domains:
            found.setdefault(term.term, []).append(term)
        return found
