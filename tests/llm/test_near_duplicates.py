"""SimHash groups, vector groups and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from msgrisk.llm import catalog, components, embeddings, shared, simhash
from msgrisk.llm.components import connected_components
from msgrisk.llm.shared import keep
from tests.llm.conftest import LONG, ODD_ROWS, documents


def least_reachable(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        folded = folded.replace(c, " ")
    words = [w for w in folded.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def groups(prints, ids):
    """Least id of each row's group, null ids left out."""
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = least_reachable(len(prints), links)
    named = {}
    for r, i in zip(roots, ids):
        if i is not None:
            named[r] = min(i, named.get(r, i))
    return [named.get(r) for r in roots]


def test_simhash_of_the_whole_table(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    expected = sorted((r.doc_id, f"{p:016x}", g) for r, p, g in zip(rows, prints, groups(prints, [r.doc_id for r in rows])))
    found = catalog.QUERIES["op1_simhash_near_duplicates"](spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == expected


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = ODD_ROWS
    prints = [plain_fingerprint(t) for _, t in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    expected = sorted(((i, p - (1 << 64) if p >> 63 else p, g) for (i, _), p, g in zip(rows, prints, groups(prints, [i for i, _ in rows]))), key=key)
    found = simhash.near_duplicates(odd_docs)
    assert found.columns == ["doc_id", "fp", "component_id"]
    assert sorted(map(tuple, found.collect()), key=key) == expected
    assert simhash.near_duplicates(no_docs).count() == 0


def test_fingerprints_in_dense_groups_and_chains(spark):
    random.seed(3)
    prints = set()
    for _ in range(6):      # dense clouds, where nearly all pairs are close
        centre = random.getrandbits(64)
        for _ in range(120):
            prints.add(centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))))
    chain = random.getrandbits(64)
    for _ in range(40):     # a chain of links, far from end to end
        prints.add(chain)
        chain ^= sum(1 << b for b in random.sample(range(64), 4))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 4]
    roots = least_reachable(len(prints), links)
    sizes = Counter(roots)
    expected = sorted((prints[i], prints[r]) for i, r in enumerate(roots) if sizes[r] > 1)
    found = simhash.fingerprint_components(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    parts = {}
    for fp, component in found:
        parts.setdefault(component, []).append(fp)
    assert sorted((fp, min(group)) for group in parts.values() for fp in group) == expected


def test_one_document_of_each_group_stays(spark, odd_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 4, 6, 7, 9, 10, 11, 12, 13, None])
    assert [r.text for r in rows if r.doc_id is None] == ["a row without an id"]
    near = documents(spark, [(5, LONG), (3, LONG), (None, LONG)])
    assert [r.doc_id for r in simhash.representatives(near).collect()] == [3]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    links = chain + star + [(5, 5), (None, 3), (77, 76), (77, 76)]
    random.Random(1).shuffle(links)
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    expected = [(i, 0) for i in range(61)] + [(1000 + i, 1000) for i in range(300)] + [(76, 76), (77, 76)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --------------------------------------------------------------------- vectors
def plain_vectors(rows):
    fine = []
    for _, v, label in rows:
        ok = label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        fine.append(np.array(v, float) if ok else None)
    links = []
    for i, a in enumerate(fine):
        for j in range(i):
            b = fine[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.93:
                    links.append((i, j))
    degree = Counter(x for pair in links for x in pair)
    roots = least_reachable(len(rows), links)
    named = {}
    for r, (i, _, _) in zip(roots, rows):
        if i is not None:
            named[r] = min(i, named.get(r, i))
    out = [(i, degree[k], named.get(r), i is not None and i == named.get(r)) for k, ((i, _, _), r) in enumerate(zip(rows, roots))]
    return sorted(out, key=str)


def found_vectors(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, n long, cell string")
    return sorted(map(tuple, embeddings.near_vectors(frame, **options).collect()), key=str)


def test_vectors_of_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in catalog.table(spark, sf_dir, "embeddings").collect()]
    found = catalog.QUERIES["op8_embedding_near_duplicates"](spark, sf_dir)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_vectors(rows)


def test_vectors_in_many_tiles(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(420):
        v = centres[i % 12] + rng.normal(size=16) * 0.35 * (i % 4)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(500 + i, rows[0][1], 0) for i in range(150)]         # one vector many times
    rows += [(800 + i, [2 * x for x in rows[0][1]], 0) for i in range(3)]
    assert found_vectors(spark, rows, tile=32) == plain_vectors(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [1.0, -0.0], 1),
        (None, [1.0, 0.01], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (None, [0.0, 1.0], 5),
        (14, [3.4e38, 1.0], 1), (15, [1e-38, 1e-40], 1),
    ]
    assert found_vectors(spark, rows) == plain_vectors(rows)
    assert found_vectors(spark, []) == []


@pytest.mark.parametrize("size", [1, 3, 64, 2000])
def test_quantisation_bound_holds(size):
    rng = np.random.default_rng(size)
    a, b = rng.normal(size=(70, size)), rng.normal(size=(90, size))
    b[:40] = a[:40] + rng.normal(size=(40, size)) * 0.3
    cosine = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    found = [(int(i), int(j)) for x, y in embeddings.close_pairs(a, b, 0.93) for i, j in zip(x, y)]
    assert sorted(found) == sorted(map(tuple, np.argwhere(cosine >= 0.93).tolist()))


def test_texts_of_a_repeated_id_are_judged_apart(spark, sf_dir):
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.getrandbits(40)}" for _ in range(50)) for _ in range(3))
    kept = corpus_pipeline.one_of_near_duplicates(spark, documents(spark, [(1, a), (1, b), (1, b), (2, b), (3, c), (2, c), (2, None), (2, "")]), sf_dir)
    rows = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert rows == sorted([(1, a), (1, b), (2, c), (2, "")])


def test_very_large_and_small_components_link(spark):
    rows = [(1, [1e200, 1e200, 0.0], "a"), (2, [1e-200, 1e-200, 0.0], "a"), (3, [1.0, 1.0, 0.01], "a"), (4, [1e308, -1e308, 0.0], "a"), (5, [5e-324, 0.0, 0.0], "a")]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


# ---------------------------------------------------------------- joins of many rows
def noted_plans(monkeypatch, *modules):
    """The plans of all tables that these modules keep, as Spark makes them from the sizes it takes tables to have."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return keep(df)

    for m in modules:
        monkeypatch.setattr(m, "keep", noted)
    return plans


def close_texts(n):
    """Texts of pairs that differ in their last word."""
    return [(i, " ".join(f"w{(i // 2 * 31 + k * k) % 1009}" for k in range(40)) + f" end{i % 2}") for i in range(n)]


def test_exploded_fingerprints_are_not_broadcast(spark, monkeypatch):
    """Each fingerprint stands in 35 rows, which Spark takes to be as small as the one."""
    plans = noted_plans(monkeypatch, simhash)
    found = simhash.near_duplicates(documents(spark, close_texts(60))).collect()
    assert len(found) == 60 > len({r.component_id for r in found})
    exploded = [p for p in plans if "Generate explode" in p]
    assert exploded and not any("Broadcast" in p for p in exploded)


def test_joins_of_many_rows_are_not_broadcast(spark, monkeypatch):
    """However small Spark takes them to be: files may be compressed well."""
    expected = sorted(map(tuple, simhash.near_duplicates(documents(spark, close_texts(60))).collect()))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1, raising=False)
    plans = noted_plans(monkeypatch, simhash, components)
    found = simhash.near_duplicates(documents(spark, close_texts(60)))
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert sum("Join" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)
    assert sorted(map(tuple, found.collect())) == expected


def test_rows_without_id_of_one_fingerprint_count_once(spark, monkeypatch):
    """Before they are met with the documents: they may be many and their file small."""
    docs = documents(spark, [(None, "the same text of many rows")] * 50 + [(None, "another text")])
    found = simhash.near_duplicates(docs)
    joined = simhash._nameless(docs, found)
    assert sorted(r.text for r in joined.collect()) == ["another text", "the same text of many rows"]
    side = joined._jdf.queryExecution().optimizedPlan().toString().split("LeftSemi")[1]
    assert "Aggregate [_print" in side
