"""Near-duplicate vectors of a label by int8 tile products with error bounds, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from msgrisk.llm.components import connected_components
from msgrisk.llm.shared import keep, regrouped

THRESHOLD = 0.93
TILE = 1024                 # vectors on each side of a tile
_STRIP = 1 << 16            # pairs recomputed at once


def usable(vector: Column) -> Column:
    """True for vectors without null, infinite or NaN components that are not zero."""
    limit = F.lit(float("inf")).cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of at most 127, the scale of each row, and a bound on the length of what rounding took away."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    left = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1))
    return codes.astype(np.int8), scale, left * (1 + 1e-9) + 1e-12


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows whose largest component lies between a half and one."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0.0))[1][:, None])


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i of ``a`` and j of ``b`` with a cosine of at least ``threshold``, in strips.

    Unit vectors are x = q + e with whole-number codes q (scaled) and a known length of e, so a product is at
    most q.q' + |q||e'| + |e||q'| + |e||e'|.  Only pairs whose bound reaches the threshold are computed from
    the full vectors.  Products of the codes are sums of whole numbers below 2**24 in strips of columns, hence
    exact in float32.  Rows are first scaled by a power of two, which changes no cosine, so that squares of very
    large or small components stay within doubles.
    """
    a, b = scaled(a), scaled(b)
    length_a, length_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    unit_a, unit_b = a / length_a[:, None], b / length_b[:, None]
    code_a, scale_a, left_a = quantised(unit_a)
    code_b, scale_b, left_b = quantised(unit_b)
    for top in range(0, len(a), 256):
        rows = slice(top, top + 256)
        dots = np.zeros((len(a[rows]), len(b)))
        for at in range(0, a.shape[1], 1024):
            dots += code_a[rows, at : at + 1024].astype(np.float32) @ code_b[:, at : at + 1024].astype(np.float32).T
        bound = dots * scale_a[rows, None] * scale_b
        bound += (1 + left_a[rows, None]) * left_b + left_a[rows, None] * (1 + left_b) + left_a[rows, None] * left_b
        i, j = np.nonzero(bound >= threshold - 1e-9)
        i += top
        for at in range(0, len(i), _STRIP):
            x, y = i[at : at + _STRIP], j[at : at + _STRIP]
            cosine = np.einsum("ij,ij->i", a[x], b[y]) / (length_a[x] * length_b[y])
            linked = cosine >= threshold
            yield x[linked], y[linked]


def _roots(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each row reaches by links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for x, y in links:
            least = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], least)
            np.minimum.at(root, root[y], least)
        root = root[root]
        if (root == before).all():
            return root


def _tile(key: tuple, frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """For a pair of blocks: linked rows of each representative, and links that keep the tile's groups together."""
    frame = frame.sort_values("rep").reset_index(drop=True)
    left = frame.index[frame["block"] == key[1]].to_numpy()
    right = frame.index[frame["block"] == key[2]].to_numpy()
    vectors = np.array([np.frombuffer(v, "<f8") for v in frame["packed"]])
    mass, count = frame["n"].to_numpy(), np.zeros(len(frame), np.int64)
    links = []
    for x, y in close_pairs(vectors[left], vectors[right], threshold):
        x, y = left[x], right[y]
        once = x < y if key[1] == key[2] else np.ones(len(x), bool)
        x, y = x[once], y[once]
        np.add.at(count, x, mass[y])
        np.add.at(count, y, mass[x])
        links.append((x, y))
    root = _roots(len(frame), links)
    out = pd.DataFrame({"rep": frame["rep"], "head": frame["rep"].to_numpy()[root], "linked": count})
    return out[(out["linked"] > 0) | (out["rep"] != out["head"])]


def _tiles(reps: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Columns rep, head, linked over all pairs of blocks of a label and dimension.

    A label is cut into blocks of about ``tile`` vectors by a hash; each block goes to every block of its
    label once, so no task sees more than two of them."""
    sizes = reps.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    rows = reps.join(sizes.select(F.concat("cell", F.lit("")).alias("cell"), "blocks"), "cell")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "n", "packed")

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _tile(key, frame, threshold)

    return rows.groupBy("cell", "low", "high").applyInPandas(work, "rep long, head long, linked long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept: one row for each row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their dimensions are equal and the cosine, in double
    precision, is at least ``threshold``.  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing.  Equal vectors are compared as one that counts as many times as it occurs.
    Rows with one vec_id are separate vectors; a row without vec_id counts as a link of others but names no
    component and is not kept.
    """

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(v, "<f8").tobytes())

    fine = F.col("label").isNotNull() & usable(F.col("embedding"))
    # 0.0 is added as -0.0 and 0.0 are the same
    plain = F.when(fine, F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), plain.alias("v"))
    cell = F.concat_ws(":", F.size("v").cast("string"), "label")
    rows = keep(rows.withColumn("packed", F.when(F.col("v").isNotNull(), pack("v"))).select(
        "vec_id", F.when(F.col("packed").isNotNull(), cell).alias("cell"), "packed"))
    alone = rows.where("packed is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    reps = rows.where("packed is not null").groupBy("cell", "packed").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    reps = keep(reps.withColumn("rep", F.monotonically_increasing_id()))
    found = keep(_tiles(reps.select("cell", "packed", "rep", "n"), threshold, tile))
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    groups = groups.select(F.col("node").alias("rep"), "component")
    named = reps.select("cell", "packed", "rep", "first", "n").join(linked, "rep", "left").join(groups, "rep", "left")
    named = keep(named.withColumn("component", F.coalesce("component", "rep")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    least = least.select(regrouped(F.col("component")).alias("k"), "component_id")
    named = named.withColumn("k", regrouped(F.col("component"))).join(least, "k")
    named = named.select("cell", "packed", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    named = keep(named)
    met = rows.where("packed is not null").join(named, ["cell", "packed"])
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return met.select("vec_id", "n_links", "component_id", kept.alias("kept")).union(alone)
