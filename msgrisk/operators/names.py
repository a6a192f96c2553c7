"""Registry names near to, or contained in, short texts.

Nearest names: two texts within ``REACH`` edits share what is left of their beginnings when each drops as many
characters, so close names meet by an equality join on these keys.  Only texts without a close name are compared
further, with the names whose length and letters allow a distance below the best one found.

Contained names: one automaton over all names reads a text once, whatever their number.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from msgrisk.functions.text import bind
from msgrisk.registry import Term, constant_table

REACH = 2
PREFIX = 8                  # keys are made of so many first characters
BROADCAST_KEYS = 200_000    # a few dozen bytes each; more keys are met by a shuffled join
GRAM = 5
WORD = 64                   # letters of a name that one machine word holds
FAR_PAIRS = 1 << 18         # pairs of a text and a name that are looked at together, a few dozen bytes each
_PLACES = 1 << 32


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Small rows that cost much work, by key in as many parts as a shuffle has, whatever their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# ------------------------------------------------------------------ nearest names
def _one_less(text: Column) -> Column:
    """The text without each of its characters in turn."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
    each = F.transform(places, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))
    return F.coalesce(each, F.array().cast("array<string>"))


def deletions(text: Column) -> Column:
    """What is left of the beginning of a text when up to ``REACH`` characters are dropped.

    Beginnings do: of an alignment with k edits, the pairs within both beginnings are a common rest of
    each, and at most k characters are missing from either."""

    def all_of(start: Column) -> Column:
        found = last = F.array(start)
        for _ in range(REACH):
            last = F.flatten(F.transform(last, _one_less))
            found = F.concat(found, last)
        return F.array_distinct(found)

    return bind(F.substr(text, F.lit(1), F.lit(PREFIX)), all_of)


class FarNames:
    """Exact nearest name of texts by bounds: a name is compared only if its length and the sets of letters
    allow a distance no greater than the best one found.

    Texts are taken together, level by level of the bound.  The pairs of a level are compared at once by Myers' bit
    vectors (Hyyro's form, a word for each column of the usual table); names of more letters than a word has bits by the
    table itself."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.codes = [_codes(t.term) for t in terms]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.masks = np.array([_mask(c) for c in self.codes], np.uint64)
        self.order = np.array([t.position for t in terms], np.int64)
        self.letters = np.unique(np.concatenate([*self.codes, np.empty(0, np.uint32)]))
        # name x letter: the places of the letter in the name; the last column is for letters that no name has
        self.places = np.zeros((len(terms), len(self.letters) + 1), np.uint64)
        for row, codes in zip(self.places, self.codes):
            if len(codes) <= WORD:
                np.bitwise_or.at(row, np.searchsorted(self.letters, codes), np.uint64(1) << np.arange(len(codes), dtype=np.uint64))
        self.compared = 0

    def nearest(self, text: str) -> tuple[int, int]:
        """Distance and position of the nearest name; of equally near ones the first in registry order."""
        distance, position = self.nearest_of([text])
        return int(distance[0]), int(position[0])

    def nearest_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distances and positions of the names nearest to the texts, a bounded number of pairs at a time."""
        step = max(1, FAR_PAIRS // max(1, len(self.terms)))
        parts = [self._nearest_of(texts[at : at + step]) for at in range(0, len(texts), step)]
        parts = parts or [(np.empty(0, np.int64), np.empty(0, np.int64))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = [_codes(t) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        masks = np.array([_mask(c) for c in codes], np.uint64)[:, None]
        apart = np.maximum(np.bitwise_count(self.masks & ~masks), np.bitwise_count(masks & ~self.masks)).astype(np.int64)
        bound = np.maximum(apart, np.abs(self.size - sizes[:, None]))
        best = np.full(len(texts), 1 << 31, np.int64)
        position = np.zeros(len(texts), np.int64)
        for level in range(int(bound.max(initial=-1)) + 1):
            text, name = np.nonzero((bound == level) & (best >= level)[:, None])
            if len(text):
                gaps = self._distances(codes, sizes, text, name)
                rank = np.lexsort((self.order[name], gaps, text))
                first = rank[np.flatnonzero(np.diff(text[rank], prepend=-1))]
                at, gap, order = text[first], gaps[first], self.order[name[first]]
                better = (gap < best[at]) | ((gap == best[at]) & (order < position[at]))
                best[at[better]], position[at[better]] = gap[better], order[better]
            if not (best > level).any():
                break
        return best, position

    def _distances(self, codes: list[np.ndarray], sizes: np.ndarray, text: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Edit distances of the pairs (text, name), letter by letter of the texts, all pairs at once."""
        self.compared += len(text)
        gaps = sizes[text]                  # to a name without letters
        for i in np.flatnonzero(self.size[name] > WORD):
            gaps[i] = _table_distance(codes[text[i]], self.codes[name[i]])
        at = np.flatnonzero((self.size[name] > 0) & (self.size[name] <= WORD))
        at = at[np.argsort(-sizes[text[at]], kind="stable")]        # longest texts first: the others end on the way
        if not len(at):
            return gaps
        used, row = np.unique(text[at], return_inverse=True)
        table = np.full((len(used), max(1, int(sizes[used].max()))), len(self.letters), np.int64)
        for line, t in zip(table, used):
            place = np.searchsorted(self.letters, codes[t])
            place[place == len(self.letters)] = 0
            line[: len(codes[t])] = np.where(self.letters[place] == codes[t], place, len(self.letters))
        one, names, length = np.uint64(1), name[at], sizes[text[at]]
        last = (self.size[names] - 1).astype(np.uint64)
        more, less = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
        score = self.size[names].copy()
        for i in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -i, "left"))       # texts with more than i letters
            more, less = more[:n], less[:n]
            same = self.places[names[:n], table[row[:n], i]]
            below = (((same & more) + more) ^ more) | same | less
            up, down = less | ~(below | more), more & below
            score[:n] += ((up >> last[:n]) & one).astype(np.int64) - ((down >> last[:n]) & one).astype(np.int64)
            up, down = (up << one) | one, down << one
            more, less = down | ~(below | up), up & below
        gaps[at] = score
        return gaps


def _table_distance(text: np.ndarray, name: np.ndarray) -> int:
    steps = np.arange(len(name) + 1, dtype=np.int64)
    above = steps
    for i, code in enumerate(text):
        row = np.concatenate(([i + 1], np.minimum(above[1:] + 1, above[:-1] + (name != code))))
        above = np.minimum.accumulate(row - steps) + steps
    return int(above[-1])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _mask(codes: np.ndarray) -> np.uint64:
    """A bit for each letter, several letters may share one: a bit that differs still takes an edit."""
    return np.bitwise_or.reduce(np.uint64(1) << (codes & 63).astype(np.uint64), initial=np.uint64(0))


def nearest_names(texts: DataFrame, terms: list[Term]) -> DataFrame:
    """Columns text, distance, brand: the name nearest to each distinct value of ``texts`` (column text).

    Ties go to the first name in registry order; nulls are left out; without names there is no row."""
    spark = texts.sparkSession
    if not terms:
        return texts.limit(0).select("text", F.lit(0).alias("distance"), F.lit("").alias("brand"))
    brands = {t.position: t.brand for t in terms}
    names = constant_table(spark, [(t.term, t.position) for t in terms], "term string, position int")
    keyed = names.select(F.explode(deletions(F.col("term"))).alias("key"), "term", "position")
    n_keys = sum(1 + min(len(t.term), PREFIX) * (min(len(t.term), PREFIX) + 1) // 2 for t in terms)     # at most
    keyed = F.broadcast(keyed) if n_keys <= BROADCAST_KEYS else keyed.hint("merge")
    # A few bytes a text, but much work: spread by number, as adaptive execution would put so few bytes into one task.
    # All that follows stays in these parts.  The key is the reversed text, a one-to-one image: by the text itself the
    # rows are grouped already, and Spark would leave the spreading out.
    probes = spread(texts.where("text is not null").select("text").distinct().select(F.reverse("text").alias("back")), "back")
    probes = probes.select("back", F.reverse("back").alias("text"))
    probes = probes.select("back", "text", F.explode(deletions(F.col("text"))).alias("key"))
    distance = F.levenshtein("text", "term", REACH).cast("long")        # negative beyond the reach
    code = F.when(distance >= 0, distance * _PLACES + F.col("position"))
    close = probes.join(keyed, "key", "left").groupBy("back").agg(F.min(code).alias("code"))
    close = close.select(F.reverse("back").alias("text"), "code")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = None
        for batch in batches:
            missing = batch["code"].isna().to_numpy()
            distance, position = np.divmod(batch["code"].fillna(0).astype("int64").to_numpy(), _PLACES)
            if missing.any():
                far = far or FarNames(terms)
                distance[missing], position[missing] = far.nearest_of(batch["text"][missing].tolist())
            brand = pd.Series(position, index=batch.index).map(brands)
            yield pd.DataFrame({"text": batch["text"], "distance": distance.astype("int32"), "brand": brand})

    return close.mapInPandas(settle, "text string, distance int, brand string")


def add_nearest(rows: DataFrame, name: str, text: Column, terms: list[Term], texts: DataFrame | None = None) -> DataFrame:
    """``rows`` with column ``name``, struct(distance, brand) of the name nearest to ``text``; null where it is null.

    ``texts`` (column text) may give the values in a shorter way than by computing ``rows``.  The join is on the
    reversed text, a one-to-one image, so that a text that many rows share is split by adaptive execution."""
    values = rows.select(text.alias("text")) if texts is None else texts
    near = nearest_names(values, terms).select(F.reverse("text").alias("_text"), F.struct("distance", "brand").alias(name))
    return rows.withColumn("_text", F.reverse(text)).join(near, "_text", "left").drop("_text")


# ---------------------------------------------------------------- contained names
class NameScan:
    """Finds all names in a text with one automaton."""

    def __init__(self, terms: list[Term], whole_words: bool = False):
        self.whole_words = whole_words
        best: dict[str, tuple[int, str]] = {}
        for t in terms:
            best[t.term] = min(best.get(t.term, (t.position, t.brand)), (t.position, t.brand))
        self.finder = ahocorasick.Automaton()
        for term, (position, brand) in best.items():
            if term:
                self.finder.add_word(term, (len(term), position, brand))
        if best:
            self.finder.make_automaton()
        self.empty = not len(self.finder)

    def hits(self, text: str | None) -> set[tuple[int, str]]:
        """(position, brand) of the names in a text."""
        if not text or self.empty:
            return set()
        found = self.finder.iter(text)
        if self.whole_words:
            found = (f for f in found if not _joined(text, f[0] - f[1][0]) and not _joined(text, f[0] + 1))
        return {(position, brand) for _, (_, position, brand) in found}


def _joined(text: str, at: int) -> bool:
    """A letter or number stands there."""
    return 0 <= at < len(text) and unicodedata.category(text[at])[0] in "LN"


def first_names(terms: list[Term], *texts: Column, whole_words: bool = False) -> Column:
    """Array of the first brand, in registry order, that each of the texts names; null where none is."""

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        names = NameScan(terms, whole_words)
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)     # a single column comes bare
            yield pd.Series([[min(found)[1] if (found := names.hits(t)) else None for t in row] for row in zip(*columns)], dtype=object)

    return scan(*texts)


def all_names(terms: list[Term], text: Column, whole_words: bool = False) -> Column:
    """Array of all brands that a text names, in registry order."""

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = NameScan(terms, whole_words)
        for texts in batches:
            yield pd.Series([list(dict.fromkeys(brand for _, brand in sorted(names.hits(t)))) for t in texts], dtype=object)

    return scan(text)


def grams_of(text: Column) -> Column:
    """All runs of ``GRAM`` characters of a text that is longer."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(F.length(text) > GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def rarest_grams(terms: list[Term]) -> dict[str, list[Term]]:
    """Each name of ``GRAM`` or more characters under the one of its runs that the fewest names hold."""
    runs = {t.term: {t.term[i : i + GRAM] for i in range(len(t.term) - GRAM + 1)} for t in terms if len(t.term) >= GRAM}
    common = Counter(g for grams in runs.values() for g in grams)
    found: dict[str, list[Term]] = {}
    for t in terms:
        if t.term in runs:
            found.setdefault(min(runs[t.term], key=lambda g: (common[g], g)), []).append(t)
    return found
