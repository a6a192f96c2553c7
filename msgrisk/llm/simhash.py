"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from msgrisk.llm.components import connected_components
from msgrisk.llm.shared import keep, regrouped, set_apart, unless_many

SHINGLE_WORDS = 4
RADIUS = 4
BLOCKS = 7          # links differ in at most RADIUS blocks, so BLOCKS - RADIUS blocks are equal
HASH_SEED = 42
CHUNK = 1 << 16     # shingles hashed at once, so a long text needs no more memory than a short one
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64 bits, as a signed integer: a bit is set if over half the shingles' hashes have it.

    Words are separated by ASCII white space and only A-Z are lower-cased.  Without words it is zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    line, n = b" ".join(words), max(1, len(words) - SHINGLE_WORDS + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(ends) - n :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros((8, 256), np.int64)
    for at in range(0, n, CHUNK):
        hashes = [digest(line[a:b], HASH_SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])]
        octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS).ravel() * 2 > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _masks() -> list[int]:
    """Bit masks of the blocks, as signed integers."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [_signed(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _spread(prints: DataFrame) -> DataFrame:
    """Columns blocks, key, fp: each fingerprint once for each choice of blocks that a close one must share."""
    masks, rows = _masks(), []
    for chosen in combinations(range(BLOCKS), BLOCKS - RADIUS):
        mask = 0
        for b in chosen:
            mask |= masks[b]
        rows.append(F.struct(F.lit(sum(1 << b for b in chosen)).alias("blocks"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return prints.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.blocks", "r.key", "fp")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def _first_shared(a: Column, b: Column, blocks: Column) -> Column:
    """True for one only of the choices of blocks that a pair shares: that of its lowest equal blocks."""
    differ = a.bitwiseXOR(b)
    equal = sum((F.when(differ.bitwiseAND(F.lit(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(_masks())), F.lit(0))
    rest = equal
    for _ in range(BLOCKS - RADIUS):
        rest = rest.bitwiseAND(rest - 1)
    return equal.bitwiseXOR(rest) == blocks


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """Columns fp, component for the distinct fingerprints (column fp) that link with another one.

    First every fingerprint is linked with the least one of its block, which is one comparison each; the
    groups so found are then compared across only, so a dense group isn't paired with itself.
    """
    spread = _spread(prints)
    heads = spread.groupBy("blocks", "key").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = heads.select("blocks", regrouped(F.col("key")).alias("k"), "head")
    heads = heads.hint("merge")     # Spark takes both sides to be as few as the fingerprints: no broadcast
    crowded = keep(spread.withColumn("k", regrouped(F.col("key"))).join(heads, ["blocks", "k"]).select("blocks", "key", "fp", "head"))
    stars = crowded.where((F.col("fp") != F.col("head")) & _near(F.col("fp"), F.col("head")))
    groups = keep(connected_components(stars.select(F.col("fp").alias("a"), F.col("head").alias("b"))))

    named = groups.select(F.col("node").alias("fp"), F.col("component").alias("part"))
    rows = crowded.drop("head").join(unless_many(named, groups.count()), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    rows = keep(rows)
    n_rows = rows.count()
    mixed = rows.groupBy("blocks", "key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    mixed = mixed.select("blocks", regrouped(F.col("key")).alias("k"))
    rows = keep(rows.withColumn("k", regrouped(F.col("key"))).join(unless_many(mixed, n_rows), ["blocks", "k"], "left_semi").drop("k"))
    x, y = rows.alias("x"), unless_many(rows.alias("y"), rows.count())
    same = (F.col("x.blocks") == F.col("y.blocks")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part"))
    a, b = F.col("x.fp"), F.col("y.fp")
    across = x.join(y, same & _near(a, b) & _first_shared(a, b, F.col("x.blocks")))
    across = across.select(F.col("x.part").alias("a"), F.col("y.part").alias("b")).distinct()
    merged = keep(connected_components(across)).select(F.col("node").alias("part"), F.col("component").alias("whole"))

    members = named.union(merged.select("part", "part")).distinct()
    members = members.join(unless_many(merged, merged.count()), "part", "left")
    return members.select("fp", F.coalesce("whole", "part").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Columns doc_id, fp (signed), component_id (least doc_id of all documents reachable by links).

    One row for each row of ``docs`` (doc_id, text).  Null, empty and blank texts have fingerprint zero and
    link like others; equal texts share a fingerprint.  Rows without doc_id are kept; they take part in
    links, but only ids name a component, so it is null if none of its rows has one.
    """
    return _grouped(docs).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, *more: Column) -> DataFrame:
    """``near_duplicates`` with component, a fingerprint that names the group (an id may be the least of several), and ``more``."""
    rows = keep(docs.select("doc_id", fingerprints(F.col("text")).alias("fp"), *more))
    prints = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n_rows, n_prints = rows.count(), prints.count()
    groups = fingerprint_components(prints.select("fp"))
    grouped = prints.join(unless_many(groups, n_prints), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = keep(grouped)
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    least = least.select(regrouped(F.col("component")).alias("k"), "component_id")
    named = grouped.withColumn("k", regrouped(F.col("component"))).join(unless_many(least, n_prints), "k").select("fp", "component", "component_id")
    named = named.select(regrouped(F.col("fp")).alias("k"), "component", "component_id")
    return rows.withColumn("k", regrouped(F.col("fp"))).join(unless_many(named, n_rows), "k").drop("k")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the least doc_id.

    Of repeated rows of that id any one is kept.  Rows without doc_id go if an id is in their group, else one
    is kept for each fingerprint.  ``one_row_of_each_group`` judges the texts of a repeated id apart.
    """
    found = keep(near_duplicates(docs))
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return named.unionByName(_nameless(docs, found))


def one_row_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one with the group's least doc_id.

    Rows of one id whose texts lie in different groups are judged apart, so an id may stay with several texts.
    Rows without doc_id go if an id is in their group, else one is kept for each fingerprint.  Columns of any name
    stay as they are; of repeated rows one is kept.
    """
    docs, restored = set_apart(docs, "doc_id", "text")
    text_key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key")
    found = keep(_grouped(docs, text_key))
    first = found.where(F.col("doc_id") == F.col("component_id")).groupBy("component").agg(F.min(F.struct("doc_id", "_key")).alias("row"))
    first = unless_many(first.select("row.*"), found.count())
    named = docs.withColumn("_key", text_key).join(first, ["doc_id", "_key"], "left_semi")
    named = named.dropDuplicates(["doc_id", "_key"]).select(*docs.columns)
    return restored(named.unionByName(_nameless(docs, found)))


def _nameless(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row without doc_id for each fingerprint of the groups that have no id."""
    alone = found.where("doc_id is null and component_id is null").select(F.col("fp").alias("_print")).distinct()
    nameless = docs.where(F.col("doc_id").isNull()).withColumn("_print", fingerprints(F.col("text")))
    return nameless.join(unless_many(alone, alone.count()), "_print", "left_semi").dropDuplicates(["_print"]).select(*docs.columns)
