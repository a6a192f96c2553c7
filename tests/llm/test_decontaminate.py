"""Benchmark windows against brute force over all windows."""

import random
import re
from collections import Counter

import corpus_pipeline
from msgrisk.llm import catalog, decontaminate
from tests.llm.conftest import LONG, ODD_ROWS, documents


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws):
    if 0 < len(ws) < 5:
        return Counter([tuple(ws)])
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def best_window(doc, item, threshold=0.8):
    """Highest similarity of any window of the item's length (the whole document if it is shorter)."""
    wanted, best = shingles(item), 0.0
    if not item or not doc:
        return 0.0
    known = {w for s in wanted for w in s}
    for at in range(max(1, len(doc) - len(item) + 1)):
        window = doc[at : at + len(item)]
        if sum(w in known for w in window) * 2 < len(window):
            continue
        held = shingles(window)
        both = sum((held & wanted).values())
        best = max(best, both / (held.total() + wanted.total() - both))
    return best


def pairs(docs, items, threshold=0.8):
    return {(i, k) for i, t in docs for k, s in items if best_window(words(t), words(s)) >= threshold}


def found(spark, docs, items):
    frame = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, size int")
    rows = decontaminate.contaminated(documents(spark, docs), frame).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r for r in rows}


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in catalog.table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in catalog.table(spark, sf_dir, "benchmark").collect()]
    rows = catalog.QUERIES["op7_benchmark_decontamination"](spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == pairs(docs, items)
    by_id = dict(docs)
    for r in rows:
        window = words(by_id[r.doc_id])[r.start : r.start + r.words]
        held, wanted = shingles(window), shingles(words(dict(items)[r.item_id]))
        both = sum((held & wanted).values())
        assert abs(r.similarity - both / (held.total() + wanted.total() - both)) < 1e-6


def test_edited_passages(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 70)))) for k in range(30)]
    docs = []
    for i in range(240):
        passage = items[i % 30][1].split()
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(passage)), rng.randrange(3)
            passage[at : at + (kind > 0)] = [rng.choice(vocabulary)] if kind < 2 else []
        around = [rng.choices(vocabulary, k=rng.randint(0, 60)) for _ in range(2)]
        docs.append((i, " ".join(around[0] + passage + around[1]).title()))
    assert set(found(spark, docs, items)) == pairs(docs, items)


def test_cut_and_shifted_passages_at_the_threshold(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.getrandbits(40)}" for _ in range(58))) for k in range(20)]
    docs = []
    for i in range(600):
        passage, lost = items[i % 20][1].split(), 5 + i % 2      # similarity 49/59 or 48/60
        strange = [f"x{rng.getrandbits(40)}" for _ in range(80)]
        docs.append((i, " ".join(strange[:40] + passage[lost:] + strange[40:] if i % 4 < 2 else strange[:40] + passage[:-lost] + strange[40:])))
    rows = found(spark, docs, items)
    assert set(rows) == {(i, i % 20) for i in range(600)}
    assert all(r.similarity == (0.8 if i % 2 else 0.830508) for (i, _), r in rows.items())


def test_balanced_repeated_words(spark):
    items = [(1, "a b " * 10 + "a"), (2, "c d e f " * 6)]
    docs = [(1, "b a " * 10 + "b"), (2, "d e f c " * 6), (3, "b a b a b"), (4, "x y " + "e f c d " * 6 + " z"), (5, "a b " * 400)]
    rows = found(spark, docs, items)
    assert set(rows) == pairs(docs, items) >= {(1, 1), (5, 1)}
    assert rows[(1, 1)].similarity == 0.888889


def edited_documents(rng, items, n):
    """Passages that are cut, shifted, edited, swapped in their halves, or repeat few words, among strange ones."""
    docs = []
    for i in range(n):
        passage = items[i % len(items)][1].split()
        size, kind = len(passage), i % 5
        lost = max(1, round(size * rng.uniform(0.02, 0.1)))
        if kind == 0:
            passage = passage[lost:]
        elif kind == 1:
            passage = passage[:-lost]
        elif kind == 2:
            passage = passage[size // 2 :] + passage[: size // 2]
        elif kind == 3:
            for at in rng.sample(range(size), max(1, size // 50)):
                passage[at] = f"y{rng.getrandbits(30)}"
        else:
            at = rng.randrange(size)
            passage[at:at] = [f"z{rng.getrandbits(30)}" for _ in range(rng.randint(1, lost))]
        strange = [[f"x{rng.getrandbits(30)}" for _ in range(rng.randint(0, 50))] for _ in range(2)]
        docs.append((i, " ".join(strange[0] + passage + strange[1])))
    return docs


def test_all_windows_of_edited_passages(spark):
    """Nothing is lost, and fingerprints alone find at least nine of ten of what repeats no shingle."""
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.getrandbits(40)}" for _ in range(rng.randint(30, 120)))) for k in range(25)]
    docs = edited_documents(rng, items, 400)
    rows = found(spark, docs, items)
    expected = pairs(docs, items)
    assert set(rows) == expected and len(expected) > 250
    assert any(i % 5 == 2 for i, _ in expected)
    near = sum(r.distance is not None for r in rows.values())
    assert near >= 0.95 * len(rows) and all(r.distance is None or r.distance <= decontaminate.RADIUS for r in rows.values())


def test_what_fingerprints_find_is_not_compared_again(spark, monkeypatch):
    rng = random.Random(13)
    items = [(k, " ".join(f"w{rng.getrandbits(40)}" for _ in range(60))) for k in range(6)]
    docs = [(k, "some words before " + t + " and some behind") for k, t in items]
    compared, similar = [], decontaminate._similar
    monkeypatch.setattr(decontaminate, "_similar", lambda held, s: compared.append(held.select("doc", "item", "start").count()) or similar(held, s))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.clean_rows(documents(spark, docs), table).isEmpty()
    by_print, rest = compared
    assert by_print >= 6 and rest == 0
    compared.clear()
    monkeypatch.setattr(decontaminate, "RADIUS", -1)        # no window is near: all are compared, and found alike
    assert decontaminate.clean_rows(documents(spark, docs), table).isEmpty()
    assert compared[0] == 0 and compared[1] >= by_print


def test_swapped_halves(spark):
    """The best window of a swapped passage lies between the places that line its halves up."""
    rng = random.Random(10)
    items = [(k, " ".join(f"w{rng.getrandbits(40)}" for _ in range(100))) for k in range(12)]
    docs = [(k, " ".join((w := t.split())[8:] + w[:8])) for k, t in items] + [(50 + k, " ".join((w := t.split())[-7:] + w[:-7])) for k, t in items]
    assert set(found(spark, docs, items)) == pairs(docs, items) == {(k + d, k) for k in range(12) for d in (0, 50)}


def test_a_repeated_shingle_is_no_square_of_places(spark):
    """Every place of the text counts once, and every window is scored."""
    items = [(1, "ha " * 800), (2, "ha " * 30 + "ho " * 30)]
    docs = [(1, "ha " * 4000), (2, "ho " * 10 + "ha " * 32 + "ho " * 28 + "ha " * 500), (3, "ha " * 700)]
    rows = found(spark, docs, items)
    assert set(rows) == pairs(docs, items)
    stored = decontaminate.keep(decontaminate.benchmark_items(spark.createDataFrame(items, "item_id long, text string")))
    kept = decontaminate._shared(documents(spark, docs), stored, 0.8)
    assert all(len(r.hits) <= r.n_words for r in kept.collect())


def test_odd_documents_and_items(spark):
    items = [(1, None), (2, ""), (3, "?!"), (4, "one two three"), (5, "ünïcödé 日本語 текст words and more words here"), (6, "a row without an id"),
             (7, "a row without an id"), (8, " ".join(["ha"] * 20)), (9, LONG), (10, "one")]
    docs = ODD_ROWS + [(50, "ha " * 3000), (51, "say one, two; three!"), (52, "one two"), (53, "ha " * 9)]
    rows = found(spark, docs, items)
    assert set(rows) == pairs(docs, items)
    assert {(6, 4), (51, 4), (None, 6), (None, 7), (9, 5), (50, 8), (7, 9), (8, 9), (5, 10)} <= set(rows)
    assert rows[(50, 8)].start == 0 and rows[(51, 4)].start == 1
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_documents_with_items_go(spark):
    docs = documents(spark, [(1, "a b c d e f g"), (2, "x y z"), (None, "a b c d e f g"), (None, "other"), (3, None)])
    items = spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_clean_rows_of_a_shared_or_missing_id_stay(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (2, "x y z"), (None, "a b c d e f g"), (None, "other"), (None, None), (3, None), (2, "b c d e f g"), (4, "x"), (4, "x")]
    docs = documents(spark, rows)
    spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "x y z"), (None, "other"), (None, None), (3, None), (4, "x"), (4, "x")], key=str)


def test_shuffled_join_gives_the_same(spark, sf_dir, monkeypatch):
    query = catalog.QUERIES["op7_benchmark_decontamination"]
    whole = sorted(map(tuple, query(spark, sf_dir).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", 0)
    assert sorted(map(tuple, query(spark, sf_dir).collect())) == whole


def test_blocks_give_all_pairs_within_the_radius(spark):
    rng = random.Random(2)
    items = [(k, 9, rng.getrandbits(64) - (1 << 63)) for k in range(12)]
    prints = []
    for i in range(600):
        base = items[i % 12][2]
        prints.append((i, 9, (((base + (1 << 64)) % (1 << 64)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 24))))))
    signed = [(i, s, p - (1 << 64) if p >> 63 else p) for i, s, p in prints]
    mask = (1 << 64) - 1
    expected = {(i, k) for i, _, p in signed for k, _, q in items if ((p ^ q) & mask).bit_count() <= decontaminate.RADIUS}
    pairs_found = decontaminate._close_pairs(
        spark.createDataFrame(signed, "win long, size int, fp long"), spark.createDataFrame(items, "item long, size int, fp long")
    )
    assert {(r.win, r.item) for r in pairs_found.collect()} == expected


def test_clashing_columns_stay(spark):
    rows = [(1, "a b c d e f g", "k", 5, "f", 0.5), (2, "x y z", "k", 6, "f", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, found int, found_key string, text_key double")
    items = spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string")
    for kept in (decontaminate.clean_rows(docs, items), decontaminate.without_contaminated(docs, items)):
        assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == rows[1:]


def test_joins_of_many_windows_are_not_broadcast(spark, monkeypatch):
    """Each passage has many windows, which Spark takes to be as small as the one row they are made of."""
    plans, kept = [], decontaminate.keep

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df)

    rng = random.Random(8)
    items = [(k, " ".join(rng.choices([f"w{i}" for i in range(300)], k=40))) for k in range(4)]
    docs = [(i, " ".join([f"before{i}"] * (i % 7) + items[i % 4][1].split() + ["after"] * 9)) for i in range(20)] + [(99, "clean text of some words"), (None, items[0][1])]
    monkeypatch.setattr(decontaminate, "keep", noted)
    monkeypatch.setattr("msgrisk.llm.shared.BROADCAST_ROWS", -1, raising=False)
    stay = decontaminate.clean_rows(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in stay.collect()] == [99]
    # the shingles of the benchmark and the texts that share some with it have bounds of their own
    assert {key for p in plans for key in re.findall(r"Broadcast\w+Join \[([a-z_]+)", p)} == {"gram", "text_key"}
