"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from msgrisk.llm import lexical_search

from tests.llm.conftest import ODD_ROWS, documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in set(items):
        terms = set(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for doc_id, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if no_id else i, -s) for rank, (s, no_id, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, rank int, score long")


def found(docs, items, **more):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **more).collect()), key=str)


def made(seed, n_docs):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(draw.choices(words, common, k=draw.randint(0, 80)))) for i in range(n_docs)]
    return docs, [(i, " ".join(draw.choices(words, common, k=draw.randint(1, 30)))) for i in range(25)]


@pytest.mark.parametrize("postings", [50, 4_000_000])
def test_equals_all_scores(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "MOST_POSTINGS", postings)
    docs, items = made(postings, 400)
    docs += [(i % 5, "w1 w2 W3!") for i in range(30)]           # ties and repeated ids
    assert found(documents(spark, docs).repartition(3), items_of(spark, items)) == plain(docs, items)
    assert found(documents(spark, docs), items_of(spark, items), most_terms=40, k=3) == plain(docs, items, 3)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    items = [(1, None), (2, ""), (3, "!!"), (4, "ONE two, three"), (4, "word1 OF2 one"), (4, "ONE two, three"), (None, "row id"), (6, "ünïcödé ÜNÏCÖDÉ 日本語"), (7, "absent")]
    assert found(odd_docs, items_of(spark, items)) == plain(ODD_ROWS, items)
    assert found(no_docs, items_of(spark, items)) == [] and found(odd_docs, items_of(spark, [])) == []


def test_reading_stops_early():
    """Best positions end the search before most documents are looked at, and never too early."""
    draw = np.random.default_rng(4)
    n, size = 5000, 40
    terms = [np.flatnonzero(draw.random(size) < 0.15).astype("<i4") for _ in range(n)]
    terms = [t if len(t) else np.array([0], "<i4") for t in terms]
    times = [draw.zipf(1.6, len(t)).clip(1, 1000) for t in terms]
    shard = lexical_search.Shard(np.arange(n), terms, times, draw.integers(10, 400, n), size)
    looked = 0
    for _ in range(20):
        chosen = np.unique(draw.integers(0, size, 4))
        weights = draw.integers(0, 5000, len(chosen))
        docs, scores, n_docs = shard.search(chosen, weights, np.empty(0, np.int64), 10)
        value = np.zeros(size, np.int64)
        value[chosen] = weights
        whole = np.add.reduceat(value[shard.term] * shard.impact, shard.begin[:-1])
        best = sorted(zip((-scores).tolist(), docs.tolist()))[:10]
        right = [(s, d) for s, d in sorted(zip((-whole).tolist(), range(n)))[:10] if s]
        assert [r for r in best if r[0]] == right
        assert not shard.seen.any() and not shard.scored.any() and not shard.weights.any()
        looked += n_docs
    assert looked < 0.5 * 20 * n
