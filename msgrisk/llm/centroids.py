"""Centroid clustering of whole-number vectors with a pivot table (LAESA).

The distance of every vector to a few fixed pivots is stored once.  By the triangle inequality the difference
of two distances to a pivot is at most the distance of vector and centroid, so most centroids are ruled out
each round without touching the vector; those that are left get exact integer distances.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from msgrisk.llm.shared import keep

COMPONENTS = 64
CENTROIDS = 16
ROUNDS = 3
PIVOTS = 8
SCALE = 64
_PLAIN = 1 << 26            # up to here squares of 64 differences add up to less than 2**61
_LIMB = 10**18
_HUGE = 1 << 1000           # above all bounds, and still a double
_SLACK = 1e-12              # far above the rounding of square roots in doubles
TABLE = "vec_id long, codes binary, wide boolean, to_pivots binary"


def usable(vector: Column, components: int = COMPONENTS) -> Column:
    """True for vectors of the right size without null, infinite or NaN components."""
    limit = F.lit(float("inf")).cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return F.coalesce((F.size(vector) == components) & fine, F.lit(False))


def whole_numbers(vector: np.ndarray) -> list[int]:
    """floor(64 * x) of each component, exact for doubles of any size."""
    return [math.floor(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in vector.tolist()]


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        codes, wide = [], []
        for vector in batch["v"]:
            numbers = whole_numbers(np.asarray(vector, np.float64))
            wide.append(max(map(abs, numbers)) > _PLAIN)
            codes.append(",".join(map(str, numbers)).encode() if wide[-1] else np.array(numbers, "<i8").tobytes())
        yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "codes": codes, "wide": wide})


def _unpack(codes: pd.Series, wide: bool) -> np.ndarray:
    if wide:
        return np.array([[int(x) for x in c.split(b",")] for c in codes], object)
    return np.frombuffer(b"".join(codes), "<i8").reshape(len(codes), -1)


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances; whole numbers of any size where rows or centre hold Python integers."""
    apart = rows - centre
    return (apart * apart).sum(1)


def farthest_first(vectors: list[list[int]], n: int) -> list[list[int]]:
    """Up to ``n`` different vectors, each the farthest from those before it."""
    chosen, left = [], [v for v in vectors if max(map(abs, v)) <= _PLAIN]
    while left and len(chosen) < n:
        gaps = [min((sum((a - b) ** 2 for a, b in zip(v, c)) for c in chosen), default=1) for v in left]
        if not max(gaps):
            break
        chosen.append(left.pop(gaps.index(max(gaps))))
    return chosen


def _measure(batches: Iterator[pd.DataFrame], pivots: list[list[int]]) -> Iterator[pd.DataFrame]:
    centres = [np.array(p, np.int64) for p in pivots]
    for batch in batches:
        batch = batch.assign(to_pivots=[b""] * len(batch))
        plain = batch.index[~batch["wide"]]
        if len(plain) and centres:
            rows = _unpack(batch.loc[plain, "codes"], False)
            far = np.sqrt(np.stack([squared(rows, c).astype(np.float64) for c in centres], 1))
            batch.loc[plain, "to_pivots"] = pd.Series([x.tobytes() for x in far], index=plain, dtype=object)
        yield batch.astype({"vec_id": "Int64"})


@dataclass
class Centroids:
    """The centroids of a round, with their distances to the pivots."""

    numbers: list[list[int]]
    pivots: list[list[int]]

    def __post_init__(self) -> None:
        self.plain = [max(map(abs, c)) <= _PLAIN for c in self.numbers]
        self.centres = [np.array(c, np.int64 if p else object) for c, p in zip(self.numbers, self.plain)]
        gaps = [[sum((a - b) ** 2 for a, b in zip(c, p)) if fine else 0 for p in self.pivots] for c, fine in zip(self.numbers, self.plain)]
        self.to_pivots = np.sqrt(np.array(gaps, np.float64).reshape(len(self.numbers), len(self.pivots)))

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances from rows, given their distances to the pivots."""
        least = np.zeros((len(far), len(self.numbers)))
        for c, fine in enumerate(self.plain):
            if fine and len(self.pivots):
                at = self.to_pivots[c]
                least[:, c] = (np.abs(far - at) - _SLACK * (far + at)).max(1)
        return np.square(np.maximum(least, 0)) * (1 - _SLACK)

    def nearest(self, rows: np.ndarray, far: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances were computed."""
        kind = object if rows.dtype == object or not all(self.plain) else np.int64
        low = np.zeros((len(rows), len(self.numbers))) if far is None else self.bounds(far)
        which, best, done = low.argmin(1), np.zeros(len(rows), kind), len(rows)
        for c in np.unique(which):
            own = which == c
            best[own] = squared(rows[own], self.centres[c])
        first = which.copy()
        for c in range(len(self.numbers)):
            alive = np.flatnonzero((low[:, c] <= (best if kind is np.int64 else np.minimum(best, _HUGE)).astype(np.float64)) & (first != c))
            done += len(alive)
            gap = squared(rows[alive], self.centres[c])
            closer = ((gap < best[alive]) | ((gap == best[alive]) & (c < which[alive]))).astype(bool)
            best[alive[closer]], which[alive[closer]] = gap[closer], c
        return which, best, done


def _assigned(batches: Iterator[pd.DataFrame], centroids: Centroids) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray, np.ndarray]]:
    """For the plain and the wide rows of each batch: ids, numbers, nearest centroids, squared distances."""
    for batch in batches:
        for wide, part in batch.groupby("wide"):
            rows = _unpack(part["codes"], bool(wide))
            far = None if wide or not centroids.pivots else np.frombuffer(b"".join(part["to_pivots"]), "<f8").reshape(len(part), -1)
            which, best, _ = centroids.nearest(rows, far)
            yield part["vec_id"], rows, which, best


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        value, low = divmod(value, _LIMB)
        yield place, sign * low
        place += 1


def _totals(batches: Iterator[pd.DataFrame], centroids: Centroids) -> Iterator[pd.DataFrame]:
    """Sums of the components of each cluster, of all rows of a task; whole numbers in limbs below 10**18."""
    sums: dict[int, list[int]] = {}
    for _, rows, which, _ in _assigned(batches, centroids):
        for c in np.unique(which).tolist():
            own = rows[which == c]
            parts = [len(own), *map(int, own.sum(0))]
            sums[c] = [a + b for a, b in zip(sums[c], parts)] if c in sums else parts
    out = [(c, at, limb, part) for c, parts in sums.items() for at, value in enumerate(parts) for limb, part in _limbs(value)]
    yield pd.DataFrame(out, columns=["cluster", "at", "limb", "part"])


def _placed(batches: Iterator[pd.DataFrame], centroids: Centroids) -> Iterator[pd.DataFrame]:
    for ids, _, which, best in _assigned(batches, centroids):
        gaps = [Decimal(int(x)) if x < 10**38 else None for x in best.tolist()]
        yield pd.DataFrame({"vec_id": ids.astype("Int64").to_numpy(), "cluster": which.astype(np.int32), "gap": gaps})


def _next(table: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids moved to the floor of the mean of their vectors.  Each task sends its sums only; the driver sees those of each centroid."""
    parts = table.mapInPandas(partial(_totals, centroids=centroids), "cluster int, at int, limb int, part long")
    rows = parts.groupBy("cluster", "at", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).collect()
    sums: dict[int, list[int]] = {}
    for r in rows:
        sums.setdefault(r["cluster"], [0] * (1 + len(centroids.numbers[0])))[r["at"]] += int(r["part"]) * _LIMB ** r["limb"]
    moved = [[x // sums[c][0] for x in sums[c][1:]] if c in sums else old for c, old in enumerate(centroids.numbers)]
    return Centroids(moved, centroids.pivots)


def clusters(vectors: DataFrame, rounds: int = ROUNDS, n_centroids: int = CENTROIDS, components: int = COMPONENTS) -> DataFrame:
    """Columns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each kept row of ``vectors`` (vec_id, embedding).

    Kept are vectors of exactly ``components`` components, none null or non-finite; each becomes floor(64 * x).
    The start is the kept vectors with the least sha256 of ``1:<vec_id>``, fewer if there are fewer; rows without
    vec_id are assigned but don't start a cluster.  Repeated rows are separate vectors; those with one id are
    told apart by their numbers.  Without any vector that can start a cluster the result is empty.  Numbers of any
    size are exact; a distance or sum that a long cannot hold is null.  Other columns are ignored.
    """
    fine = vectors.where(usable(F.col("embedding"), components))
    rows = fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = keep(rows.mapInPandas(_pack, "vec_id long, codes binary, wide boolean"))
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = rows.where("vec_id is not null").orderBy(name, "wide", "codes").limit(n_centroids).collect()
    seeds = [[int(x) for x in _unpack(pd.Series([bytes(r["codes"])]), r["wide"])[0]] for r in start]
    if not seeds:
        return rows.limit(0).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    pivots = farthest_first(seeds, PIVOTS)
    table = keep(rows.mapInPandas(partial(_measure, pivots=pivots), TABLE))
    centroids = Centroids(seeds, pivots)
    for _ in range(rounds):
        centroids = _next(table, centroids)
    placed = keep(table.mapInPandas(partial(_placed, centroids=centroids), "vec_id long, cluster int, gap decimal(38,0)"))
    sums = {r["cluster"]: r for r in placed.groupBy("cluster").agg(F.sum("gap").alias("sum"), F.count_if(F.col("gap").isNull()).alias("lost")).collect()}
    inertias = [0 if c not in sums else None if sums[c]["lost"] else sums[c]["sum"] for c in range(len(seeds))]
    inertias = [None if x is None or x >= 2**63 else int(x) for x in inertias]
    whole = None if None in inertias or sum(inertias) >= 2**63 else sum(inertias)
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.numbers]

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)

    return placed.select(
        "vec_id", "cluster", F.col("gap").try_cast("long").alias("distance"), of_cluster(inertias, "long").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"), of_cluster(prints, "string").alias("centroid_sha256"),
    )
