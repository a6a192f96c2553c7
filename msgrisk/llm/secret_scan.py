"""Secret scan with an incremental ledger of text versions, by DataFrame functions only.

A text version is named by the SHA-256 of its content (its blob).  The ledger, a folder with two tables,
holds which rule versions a blob was scanned with and what they found.  A scan looks at unseen pairs of
blob and rule version only, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from msgrisk.llm.shared import keep


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds all matches, leftmost and without overlap; those whose ``group`` is shorter than
    ``least`` are dropped, though they still take their place."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12, 2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),      # shorter runs are left out at once: a run is matched whole anyway
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 1),
)
BASE_KINDS = ("assign", "access", "hex")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scanned(spark: SparkSession, ledger: str) -> DataFrame:
    return _table(spark, f"{ledger}/scanned", "blob string, kind string, version int")


def findings(spark: SparkSession, ledger: str) -> DataFrame:
    """All findings: places in code points, end exclusive."""
    return _table(spark, f"{ledger}/findings", "blob string, kind string, version int, start long, end long")


def _matches(rule: Rule) -> Column:
    """Array of (gap, size, value): characters before a match, of it, and of the group that must be long."""
    pattern = F.lit(rule.pattern)
    sizes = F.transform(F.regexp_extract_all("text", pattern, 0), F.length)
    values = F.transform(F.regexp_extract_all("text", pattern, rule.group), F.length) if rule.group else sizes
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), values.alias("value"))
    wanted = F.array_contains("unseen", rule.kind) & F.col("text").rlike(rule.pattern)
    return F.when(wanted, rows)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger has not seen of ``versions`` (text); returns the number of blobs scanned.

    Findings are written before the blobs are marked as scanned: a run that breaks off between the two
    writes them again, and readers take distinct findings.
    """
    spark = versions.sparkSession
    spark_rules = [(r.kind, r.version) for r in rules]
    seen = scanned(spark, ledger).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    blobs = versions.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    known = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in spark_rules))
    due = F.array_except(known, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>")))
    todo = blobs.join(seen, "blob", "left").withColumn("due", due).where(F.size("due") > 0)
    todo = todo.withColumn("unseen", F.col("due.kind"))
    found = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _matches(r).alias("rows")) for r in rules))
    result = keep(todo.select("blob", "due", F.filter(found, lambda x: x["rows"].isNotNull()).alias("found")))
    each = result.select("blob", F.explode("found").alias("f"))
    each = each.select("blob", "f.kind", "f.version", "f.least", F.posexplode("f.rows").alias("at", "m"))
    upto = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum((F.col("m.gap") + F.col("m.size")).cast("long")).over(upto)
    spans = each.withColumn("end", ends).where(F.col("m.value") >= F.col("least"))
    spans = spans.select("blob", "kind", "version", (F.col("end") - F.col("m.size")).alias("start"), "end")
    spans.write.mode("append").parquet(f"{ledger}/findings")
    marks = result.select("blob", F.explode("due").alias("d")).select("blob", "d.kind", "d.version")
    marks.write.mode("append").parquet(f"{ledger}/scanned")
    return result.count()


def blob_spans(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns blob, spans: the distinct findings of these rule versions, by start, then kind in rule order."""
    order = F.array(*(F.lit(r.kind) for r in rules))
    wanted = findings(spark, ledger).where(" or ".join(f"(kind = '{r.kind}' and version = {r.version})" for r in rules))
    rows = wanted.withColumn("rank", F.array_position(order, F.col("kind"))).select("blob", F.struct("start", "rank", "end", "kind").alias("s"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (any columns, with text) with blob and spans: an array of (start, rank, end, kind), empty if clean.

    Texts are scanned once however many paths hold them; null counts as empty.  Columns of ``docs`` named
    blob or spans are replaced.
    """
    scan(docs.select("text"), ledger, rules)
    found = keep(blob_spans(docs.sparkSession, ledger, rules))
    rows = docs.drop("blob", "spans").withColumn("blob", blob_of(F.col("text")))
    empty = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans cover replaced by a mark; overlapping spans count as one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done, s):
        gap = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(done["out"], gap, F.lit(mark)).alias("out"))
        wider = F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        return F.when((s["start"] >= done["at"]) , fresh).otherwise(wider)

    end = F.aggregate(spans, start, step, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)
