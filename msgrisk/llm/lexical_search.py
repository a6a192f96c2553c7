"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are dealt into shards; a shard has, for each term, its documents by falling impact.  The lists of an
item's terms are read side by side.  A document met in one list is looked up in all others at once, and every
place so seen is marked.  What no list has shown yet lies behind the contiguous seen places of every list, so
the impacts there bound its score; that bound falls faster than that of the places last read.  Reading stops
when it is strictly below the kth score found, as an equal score could still win by a smaller id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from msgrisk.llm.shared import keep

BEST = 10
STEP = 16                   # places of each list read first; the step doubles each time
MOST_TERMS = 250_000        # terms of the items searched in one pass over the documents, about 40 MB a task
MOST_POSTINGS = 4_000_000   # of a shard, about 250 MB with its lists
_SALTS = 64
# A-Z to a-z; every other ASCII character but digits and letters parts terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NO_ID = (1 << 63) - 1      # for the order of documents without id
ROWS = "doc_id long, n long, terms binary, times binary"
FOUND = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and all other characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split(b" ") if text else []


def _terms(text: str | None) -> list[bytes]:
    return [t for t in terms_of(text) if t]


def impacts(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _indexed(batches: Iterator[pd.DataFrame], vocabulary: dict[bytes, int]) -> Iterator[pd.DataFrame]:
    """For each document its number of terms, and those of the vocabulary with the times they occur."""
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
            words = Counter(_terms(text))
            held = [(vocabulary[w], n) for w, n in words.items() if w in vocabulary]
            pairs = np.array(held, np.int64).reshape(-1, 2)
            out.append((doc_id, sum(words.values()), pairs[:, 0].astype("<i4").tobytes(), pairs[:, 1].astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "times"]).astype({"doc_id": "Int64"})


def _held(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Documents of a task that hold each term."""
    counts = np.zeros(size, np.int64)
    for batch in batches:
        counts += np.bincount(np.frombuffer(b"".join(batch["terms"]), "<i4"), minlength=size)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"term": at, "df": counts[at]})


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the runs that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Shard:
    """Impact lists of some documents, and their postings by document for direct accesses."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], times: list[np.ndarray], m: np.ndarray, size: int):
        self.ids, lengths = ids, np.array([len(t) for t in terms], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(lengths)))
        self.term, doc = np.concatenate(terms), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        self.impact = impacts(np.concatenate(times).astype(np.int64), np.repeat(m, lengths))
        order = np.lexsort((-self.impact, self.term))
        self.place = np.empty(len(order), np.int32)         # of each posting, among all lists
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_begin = np.searchsorted(self.term[order], np.arange(size + 1))
        self.seen = np.zeros(len(order), bool)
        self.weights, self.scored = np.zeros(size, np.int64), np.zeros(len(ids), bool)

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents, scores and the number of documents looked at.  ``floor`` are up to k scores known from elsewhere."""
        begin, end = self.list_begin[terms], self.list_begin[terms + 1]
        live = (end > begin) & (weights > 0)
        terms, weights, begin, end = terms[live], weights[live], begin[live], end[live]
        self.weights[terms] = weights
        best, read, step = begin.copy(), begin.copy(), STEP
        found, scores, top, marked = [], [], floor, []
        while len(terms):
            upto = np.minimum(read + step, end)
            docs = np.unique(self.list_doc[_runs(read, upto - read)])
            docs, read, step = docs[~self.scored[docs]], upto, step * 2
            if len(docs):
                sizes = self.begin[docs + 1] - self.begin[docs]
                at = _runs(self.begin[docs], sizes)
                value = self.weights[self.term[at]]         # direct accesses: all lists of the item at once
                mine = value > 0
                marked.append(self.place[at[mine]])
                self.seen[marked[-1]] = True
                new = np.add.reduceat(value * self.impact[at], np.cumsum(sizes) - sizes)
                self.scored[docs] = True
                found.append(docs)
                scores.append(new)
                top = np.sort(np.concatenate([top, new]))[::-1][:k]
            bound = 0
            for i, (a, z) in enumerate(zip(best.tolist(), end.tolist())):
                if a < z:
                    rest = self.seen[a:z]
                    first = int(rest.argmin())
                    best[i] = a = z if rest[first] else a + first
                if a < z:
                    bound += int(weights[i]) * int(self.list_impact[a])
            if bound == 0 or (len(top) == k and bound < top[-1]):
                break
        self.weights[terms] = 0
        for places in marked:
            self.seen[places] = False
        docs = np.concatenate(found) if found else np.empty(0, np.int64)
        self.scored[docs] = False
        return docs, np.concatenate(scores) if scores else np.empty(0, np.int64), len(docs)


@dataclass
class Items:
    """Terms (numbers) and their weights of the items of a pass; corpus statistics."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    n_terms: int
    size: int


def _search(batches: Iterator[pd.DataFrame], items: Items, k: int) -> Iterator[pd.DataFrame]:
    """The best documents of each item among those of a task, shard by shard."""
    tops: list[list[tuple[int, int, bool]]] = [[] for _ in items.terms]
    ids: list[int | None] = []
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    postings = 0

    def flush() -> None:
        m = np.array([10 + 90 * n * items.n_docs // items.n_terms for _, _, n in held], np.int64)
        shard = Shard(np.array([_NO_ID if i is None else i for i in ids], np.int64), [t for t, _, _ in held], [x for _, x, _ in held], m, items.size)
        for i, (terms, weights) in enumerate(zip(items.terms, items.weights)):
            docs, scores, _ = shard.search(terms, weights, np.array([s for s, _, _ in tops[i]], np.int64), k)
            few = np.lexsort((shard.ids[docs], -scores))[:k]
            new = [(int(scores[x]), int(shard.ids[docs[x]]), ids[docs[x]] is None) for x in few if scores[x] > 0]
            tops[i] = sorted(tops[i] + new, key=lambda r: (-r[0], r[2], r[1]))[:k]
        ids.clear()
        held.clear()

    for batch in batches:
        for doc_id, n, terms, times in zip(batch["doc_id"].astype("Int64"), batch["n"], batch["terms"], batch["times"]):
            if len(terms):
                ids.append(None if doc_id is pd.NA else int(doc_id))
                held.append((np.frombuffer(terms, "<i4"), np.frombuffer(times, "<u4"), int(n)))
                postings += len(held[-1][0])
                if postings >= MOST_POSTINGS:
                    flush()
                    postings = 0
    if held:
        flush()
    rows = [(i, None if no_id else doc_id, score) for i, top in enumerate(tops) for score, doc_id, no_id in top]
    yield pd.DataFrame(rows, columns=["item", "doc_id", "score"]).astype({"doc_id": "Int64"})


def _blocks(items: DataFrame, most_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of a bounded number of terms, read from Spark one after another."""
    block, size = [], 0
    for row in items.toLocalIterator():
        terms = list(dict.fromkeys(_terms(row["text"])))
        if block and size + len(terms) > most_terms:
            yield block
            block, size = [], 0
        if terms:
            block.append((row["item_id"], terms))
            size += len(terms)
    if block:
        yield block


def _pass(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    spark, vocabulary = docs.sparkSession, {}
    numbers = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int64) for _, terms in block]
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(partial(_indexed, vocabulary=vocabulary), ROWS))
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select("terms").mapInPandas(partial(_held, size=len(vocabulary)), "term int, df long")
    df = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    by_term = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    items = Items(numbers, [by_term[x] for x in numbers], n_docs, max(n_terms, 1), len(vocabulary))
    found = rows.mapInPandas(partial(_search, items=items, k=k), FOUND)
    last_id = F.col("doc_id").asc_nulls_last()
    # Two steps, so that an item's rows of all tasks don't meet in one.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    few = Window.partitionBy("item", "salt").orderBy(F.col("score").desc(), last_id)
    some = salted.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), last_id)
    best = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, most_terms: int = MOST_TERMS) -> DataFrame:
    """Columns item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) with a score above 0 for each item (item_id, text).

    Equal scores rank by doc_id, documents without one last; repeated rows and ids are documents of their own.
    Null, empty and termless texts have no terms, count nowhere and are never found; such items give no rows.
    Repeated equal rows of items count once; different texts of one item_id are ranked apart.  Empty tables give an
    empty one; other columns are ignored.  The items' terms go to every task, so items are searched in blocks of
    at most ``most_terms`` terms (or one item), each in a pass over all documents.
    """
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    out = None
    for block in _blocks(wanted, most_terms):
        part = _pass(docs, block, k)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
