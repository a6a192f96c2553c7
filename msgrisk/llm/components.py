"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from msgrisk.llm.shared import keep, regrouped, unless_many


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns node, component (least node reachable) for every node of ``links`` (long columns a, b).

    Each round hangs all neighbours of a node on the least of them, first the greater neighbours, then
    the lesser ones; the rounds needed grow with the logarithm of the longest chain.  A node with very
    many neighbours is aggregated by partial minima and joined back by a join that can be split.  Links to
    itself and links with a null are ignored; an empty table gives an empty one.
    """
    pairs = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs = keep(pairs.where("hi <> lo").distinct())
    before = _digest(pairs)
    for _ in range(most_rounds):
        most = 2 * before[0]     # each pair counts for both its nodes
        pairs = keep(_small_star(_large_star(pairs, most), most))
        after = _digest(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.union(members.select("component", "component").distinct())


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _with_least(pairs: DataFrame, node: str, other: str, most_rows: int) -> DataFrame:
    """Adds ``least``: the least ``other`` of the row's ``node``.  There are at most ``most_rows`` pairs."""
    least = pairs.groupBy(node).agg(F.min(other).alias("least"))
    least = least.select(regrouped(F.col(node)).alias("k"), "least")
    return pairs.withColumn("k", regrouped(F.col(node))).join(unless_many(least, most_rows), "k").drop("k")


def _large_star(pairs: DataFrame, most_rows: int) -> DataFrame:
    both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
    starred = _with_least(both, "u", "v", most_rows).where("v > u")
    return starred.select(F.col("v").alias("hi"), F.least("u", "least").alias("lo")).distinct()


def _small_star(pairs: DataFrame, most_rows: int) -> DataFrame:
    starred = _with_least(pairs, "hi", "lo", most_rows)
    out = starred.select("hi", F.col("least").alias("lo")).union(starred.where("lo <> least").select("lo", "least"))
    return out.distinct()
