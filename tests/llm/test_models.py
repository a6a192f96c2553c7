"""Toxicity, quality and language: held-out accuracy, matching against plain search, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgrisk.llm import catalog, language, ngrams, quality, shared, toxicity
from msgrisk.llm.shared import labelled_sample
from tests.llm.conftest import ODD_ROWS, documents

SF = "/root/testdata/sf0.01"


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def result(spark, name):
    return {r.doc_id: r for r in catalog.QUERIES[name](spark, SF).collect()}


def labels(spark):
    return catalog.table(spark, SF, "labels").collect()


def test_toxicity_of_held_out_documents(spark):
    found, known = result(spark, "op4_toxicity"), labels(spark)
    assert len(found) == 1000
    assert all(r.held_out == (fold(i, 3) == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in found.items())
    held = [r for r in known if fold(r.doc_id, 3) == 1]
    hits = Counter((r.toxic, found[r.doc_id].predicted) for r in held)
    assert hits[(0, 1)] <= 2 and hits[(1, 1)] >= 0.8 * (hits[(1, 1)] + hits[(1, 0)])


def test_quality_of_held_out_documents(spark):
    found, known = result(spark, "op9_quality"), labels(spark)
    assert len(found) == 1000
    assert all(r.held_out == (fold(i, 3) == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in found.items())
    held = [r for r in known if fold(r.doc_id, 3) == 1]
    assert np.mean([found[r.doc_id].predicted == r.quality for r in held]) >= 0.95


def test_language_of_held_out_documents(spark):
    found = result(spark, "op10_language")
    rows = catalog.table(spark, SF, "documents").select("doc_id", "lang", "text").collect()
    assert len(found) == 1000
    assert all(found[r.doc_id].held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if fold(r.doc_id, 4) == 2]
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97


# -------------------------------------------------------------------- toxicity
TOXIC = [f"you are {'abcdefgh'[i % 8]} {w} and {'stuvwxyz'[i % 8]} {x} w{i % 13}" for i, (w, x) in enumerate([("scoundrel", "fool"), ("nasty scoundrel", "x"), ("big fool", "y")] * 20)]
CLEAN = [f"you are a kind one number{i} and good" for i in range(50)] + ["the royal fool of the play"] * 6


@pytest.fixture(scope="module")
def lexicon():
    return toxicity.fit(TOXIC + CLEAN, [1] * len(TOXIC) + [0] * len(CLEAN))


def test_folding():
    assert toxicity.folded("Sc0undr3l! $coundrel ѕсоundrel s​coundrel 2024 1") == " scoundrel scoundrel scoundrel scoundrel "
    assert toxicity.folded(None) == toxicity.folded(" 12 ") == " "


def test_lexicon_and_exceptions(lexicon):
    matcher = lexicon.automaton()
    score = lambda t: toxicity.probability(toxicity.density(t, matcher), lexicon)
    assert score("what a sc0undrel") >= 0.7
    assert score("what a ѕсоundrel") >= 0.7
    assert score("what a fool") >= 0.7 and score("here is the royal fool") < 0.3
    assert score("a kind one") < 0.3 and score(None) == score("") < 0.3
    assert score("a scoundrel " + "of words " * 3000) < score("a scoundrel")


def test_matches_are_those_of_a_plain_search(lexicon):
    rng, words = random.Random(3), ["scoundrel", "fool", "royal", "the", "scoundrels", "a", "nasty", "und"]
    for _ in range(200):
        plain = toxicity.folded(" ".join(rng.choices(words, k=rng.randint(0, 12))))
        total = 0.0
        for i in range(len(plain)):
            before = plain.rfind(" ", 0, i)
            phrases = [p for p in lexicon.exceptions if plain.startswith(p, i) or (before >= 0 and plain.startswith(p, before) and p.rindex(" ", 0, -1) == i - before)]
            total += sum(w for e, w in lexicon.weights.items() if plain.startswith(e, i) and e not in [lexicon.exceptions[p] for p in phrases])
        expected = total / max(1, plain.count(" ")) ** 0.5
        assert toxicity.density(plain, lexicon.automaton()) == pytest.approx(expected)


def test_models_without_labels():
    assert toxicity.probability(toxicity.density("any", toxicity.fit([], []).automaton()), toxicity.fit([], [])) < 0.1
    assert quality.fit([], []).probability("any", "1") == 0.5
    assert quality.fit(["a b"], ["0"]).probability("any", "1") == 0.0
    assert language.Tagger(language.fit([], [])).predict("some words") == ("und", 0.0)


# --------------------------------------------------------------------- n-grams
def test_grams_are_those_of_each_word():
    words = ["a", "été", "strength", "ab", "x" * 60]
    codes = ngrams.codes_of(words)
    for size in (1, 2, 3, 5):
        expected = []
        for k, w in enumerate(words):
            marked = f" {w} "
            runs = [marked[i : i + size] for i in range(len(marked) - size + 1)]
            expected += [(r, k) for r in runs if size > 1 or r != " "]
        hashes, numbers = ngrams.gram_hashes(codes, size)
        assert numbers.tolist() == [k for _, k in expected]
        by_run = {}
        for (run, _), h in zip(expected, hashes.tolist()):
            assert by_run.setdefault(run, h) == h
        assert len(set(by_run.values())) == len(by_run)
    assert len(set(ngrams.word_hashes(codes).tolist())) == len(words)
    assert ngrams.word_hashes(ngrams.codes_of(["ab", "ab", "ba"])).tolist()[0:2] == [ngrams.word_hashes(ngrams.codes_of(["ab"]))[0]] * 2


def test_quality_of_long_texts_follows_all_words(monkeypatch):
    model = quality.fit(["good plain words here", "bad bad bad bad", "more good words", "junk junk junk"], ["1", "0", "1", "0"])
    text = "good words " * 5000 + "junk junk " * 5000
    whole = model.probability(text, "1")
    monkeypatch.setattr(ngrams, "CHUNK_WORDS", 7)
    assert model.probability(text, "1") == pytest.approx(whole, abs=1e-9)


# -------------------------------------------------------------------- language
@pytest.fixture(scope="module")
def tagger():
    english = "the quick brown fox jumps over the lazy dog while this house was there with them and that thing".split()
    spanish = "el rápido zorro marrón salta sobre perro perezoso mientras esta casa estaba allí con ellos cosa".split()
    russian = "быстрая лиса прыгает через ленивую собаку пока этот дом был там".split()
    rng = random.Random(1)
    texts = [" ".join(rng.choices(w, k=20)) for w in (english, spanish, russian) for _ in range(30)]
    return language.Tagger(language.fit(texts, ["en"] * 30 + ["es"] * 30 + ["ru"] * 30))


def test_spans_of_mixed_text(tagger):
    text = "the lazy dog jumps over the house, el perro perezoso salta sobre esta casa, быстрая лиса прыгает"
    assert [s[0] for s in tagger.spans(text)] == ["en", "es", "ru"]
    assert tagger.spans(text)[1] == ("es", 7, 14)


def test_scripts_rule_languages_out(tagger):
    assert tagger.predict("дом") == ("ru", 1.0)
    assert (tagger.scores(["дом"])[0] == language.FLOOR).sum() == 2
    assert np.abs(tagger.scores(["日本"])).max() == 0
    assert language.script_of("д") == "cyrillic" and language.script_of("日") == "han" and language.script_of("é") == "latin"


def test_path_is_the_best_one(tagger):
    rng = random.Random(8)
    words = "the house el perro zorro that дом лиса casa dog con over".split()

    def best(scores, penalty):
        value = scores[0].copy()
        for row in scores[1:]:
            value = np.maximum(value, value.max() - penalty) + row
        return value.max()

    for _ in range(150):
        chosen = rng.choices(words, k=rng.randint(1, 30))
        scores, path = tagger.scores(chosen), tagger.path(chosen)
        worth = scores[np.arange(len(chosen)), path].sum() - tagger.penalty * (np.diff(path) != 0).sum()
        assert worth == pytest.approx(best(scores, tagger.penalty))


def test_odd_texts(tagger):
    assert [tagger.predict(t) for t in (None, "", " 12 !", "🙂")] == [("und", 0.0)] * 4
    assert tagger.predict("The HOUSE")[0] == "en"


# ---------------------------------------------------------------- odd tables
def test_odd_rows_of_all_models(spark, odd_docs, no_docs, lexicon, tagger):
    model = quality.fit(["good plain words", "bad bad bad"], ["1", "0"])
    ids = Counter(i for i, _ in ODD_ROWS)
    for docs, expected in ((odd_docs, ids), (no_docs, Counter())):
        for scored, column in ((toxicity.scored(docs, lexicon), "toxic_score"), (quality.scored(docs, model), "quality_score")):
            rows = scored.select("doc_id", F.col(column).alias("s")).collect()
            assert Counter(r.doc_id for r in rows) == expected
            assert all(0 <= r.s <= 1 for r in rows)
        rows = language.identified(docs, tagger.model).select("doc_id", "language.lang_pred", "language.score").collect()
        assert Counter(r.doc_id for r in rows) == expected
        assert all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3))


def test_sample_is_bounded_and_usable(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(60)] + [(3, "text 3"), (None, "x"), (70, None)])
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = labelled_sample(docs, marks, "quality", 10, catalog.held_out(3, 1))
    assert len(rows) <= 20 and rows["doc_id"].is_unique
    assert all(fold(i, 3) == 1 and t == f"text {i}" for i, t in zip(rows["doc_id"], rows["text"]))
    assert set(rows.loc[rows["doc_id"] == 3, "label"]) <= {"0"}
    empty = labelled_sample(docs.limit(0), marks, "quality", 10, catalog.held_out(3, 1))
    assert empty.empty and quality.learn(docs.limit(0), marks, catalog.held_out(3, 1)).classes == ()


def test_an_insult_in_few_phrases_is_learned_from_any_number_of_texts():
    """Neither more texts nor more entries push an entry out; copies of one text don't bring one in."""
    draw = random.Random(4)
    phrases = ["you grumbo", "such a grumbo today", "that grumbo again", "grumbo go home", "total grumbo"]
    vocabulary = [f"w{i}x" for i in range(2000)]
    for n in (300, 3000):
        clean = [" ".join(draw.choices(vocabulary, k=30)) for _ in range(n)]
        toxic = [" ".join(draw.choices(vocabulary, k=15)) + f" {phrases[i % 5]} " + " ".join(draw.choices(vocabulary, k=15)) for i in range(n)]
        copies = ["zonko " + " ".join(draw.choices(vocabulary, k=200))] * 500
        found = toxicity.fit(clean + toxic + copies, [0] * n + [1] * (n + 500))
        matcher = found.automaton()
        assert toxicity.probability(toxicity.density("w1x w2x grumbo w3x w4x", matcher), found) > 0.9
        assert toxicity.probability(toxicity.density("w1x w2x zonko w3x w4x", matcher), found) < 0.3
        assert toxicity.probability(toxicity.density(clean[0], matcher), found) < 0.3


def test_learned_weights_are_those_of_a_plain_count():
    draw = random.Random(5)
    vocabulary = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts = [" ".join(draw.choices(vocabulary, k=40)) for _ in range(400)]
    marks = [int(i % 2) for i in range(400)]
    texts = [t + (" blargh" if m and draw.random() < 0.8 else "") + (" snurf" if m and draw.random() < 0.4 else "") for t, m in zip(texts, marks)]
    found = toxicity.fit(texts, marks)
    assert {" blar", " snur"} == set(found.weights)
    for entry, weight in found.weights.items():
        toxic = sum(m and entry.strip() in t for t, m in zip(texts, marks))
        clean = sum(not m and entry.strip() in t for t, m in zip(texts, marks))
        assert abs(weight - (math.log((toxic + 0.1) / 200.2) - math.log((clean + 0.1) / 200.2))) < 1e-9


def test_numbers_are_no_letters(tagger):
    for text in ("\u00bd", "\u00b2", "\u2460", "\u2167", "\u00bd \u00b2 \u2160\u2161 123 _"):
        assert language.words_of(text) == [] and tagger.predict(text) == ("und", 0.0)
    assert language.words_of("x\u00b2y caf\u00e9 \u4e00\u4e8c") == ["x", "y", "caf\u00e9", "\u4e00\u4e8c"]


def test_a_repeated_id_brings_one_text(spark):
    rows = [(1, f"text {i:05d}") for i in range(10_000)] + [(2, "two"), (3, None), (None, "x")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, toxic int")
    sample = shared.labelled_sample(documents(spark, rows).repartition(6), labels, "toxic", 10, F.lit(True))
    assert sample.values.tolist() == [[1, "text 00000", "1"], [2, "two", "0"]]


def test_many_labels_give_the_same_sample(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(500)]
    labels = spark.createDataFrame([(i, i % 7) for i in range(500)], "doc_id long, kind int")
    few = shared.labelled_sample(documents(spark, rows), labels, "kind", 5, F.lit(True))
    monkeypatch.setattr(shared, "MOST_LABELS", 2)
    assert shared.labelled_sample(documents(spark, rows), labels, "kind", 5, F.lit(True)).equals(few) and len(few) == 35


def test_quality_training_equals_a_plain_one(monkeypatch):
    """The same sums written out: averaged vectors, softmax, and steps of gradient descent in the same order."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    texts = ["good plain words here", "bad bad junk junk", "more good words of prose", "junk 12 bad", "", "prose here"]
    labels = ["1", "0", "1", "0", "0", "1"]
    model = quality.fit(texts, labels, seed=3)
    rng = np.random.default_rng(3)
    table = rng.uniform(-1, 1, (quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32) / quality.DIMENSIONS
    out, offset = np.zeros((quality.DIMENSIONS, 2)), np.zeros(2)
    rows = []
    for text in texts:
        counts = Counter(int(b) for part in quality.buckets(text) for b in part)
        rows.append({b: n / sum(counts.values()) for b, n in counts.items()})
    done, steps = 0, 2 * len(texts)
    for _ in range(2):
        for i in rng.permutation(len(texts)):
            vector = sum(share * table[b].astype(float) for b, share in rows[i].items())
            z = [float(vector @ out[:, k] + offset[k]) for k in range(2)]
            total = sum(math.exp(v - max(z)) for v in z)
            error = np.array([math.exp(v - max(z)) / total - (labels[i] == "01"[k]) for k, v in enumerate(z)])
            error *= quality.RATE * (1 - done / steps)      # both classes weigh alike here
            done += 1
            back = out @ error
            out -= np.outer(vector, error)
            offset -= 0.1 * error
            for b, share in rows[i].items():
                table[b] -= (math.sqrt(share) * back).astype(np.float32)
    for text, row in zip(texts, rows):
        z = sum(share * (table[b].astype(float) @ out) for b, share in row.items()) + offset
        assert abs(model.probability(text, "1") - math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1]))) < 1e-3


def test_a_word_is_scored_once(tagger, monkeypatch):
    texts = ["the lazy dog, el perro", None, "the dog \u00bd the dog дом", "", "123", "casa casa dog", "el zorro over the house " * 50]
    alone = [language.Tagger(tagger.model).predict(t) for t in texts]
    scored = []

    class Counted(language.Tagger):
        def _fresh_scores(self, words):
            scored.extend(words)
            return super()._fresh_scores(words)

    assert list(Counted(tagger.model).predictions(texts * 3)) == alone * 3
    assert sorted(scored) == sorted({w for t in texts for w in language.words_of(t)})
    monkeypatch.setattr(language, "KNOWN_WORDS", 3)
    monkeypatch.setattr(language, "TOGETHER", 10)
    assert list(Counted(tagger.model).predictions(texts * 3)) == alone * 3
    assert list(Counted(language.fit([], [])).predictions(texts)) == [("und", 0.0)] * len(texts)
