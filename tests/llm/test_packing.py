"""Pieces against the tokenizer itself, and places against the rules of packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from msgrisk.llm import catalog, packing
from tests.llm.conftest import ODD_ROWS

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def plain_pieces(rows, size=2048):
    tokenizer = Tokenizer.from_file(catalog.TOKENIZER)
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4")
            out.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    return Counter(out)


def check_places(rows, size):
    """Every sequence is filled from 0 without a gap; returns the number of sequences."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_whole_table(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    found = catalog.QUERIES["op2_best_fit_packing"](spark, sf_dir)
    assert found.columns == COLUMNS
    places = found.collect()
    assert Counter(tuple(r)[:5] for r in places) == plain_pieces([tuple(r) for r in rows])
    total = sum(r["length"] for r in places)
    assert check_places(places, 2048) <= -(-total // 2048) * 1.02 + 1


def test_odd_rows(spark, odd_docs, no_docs):
    found = packing.pack(odd_docs, catalog.TOKENIZER).collect()
    assert Counter(tuple(r)[:5] for r in found) == plain_pieces(ODD_ROWS)
    check_places(found, 2048)
    assert packing.pack(no_docs, catalog.TOKENIZER).count() == 0


@pytest.mark.parametrize("text", [f"{a}{m} and {w}{a}{m}!" for a, m in zip("HTWYJT", "\u0331\u0308\u030a\u030a\u030c\u0344") for w in ("", "Wo")] + ["H\u1dc4\u0331 X."])
def test_capitals_with_combining_marks(text):
    ids = packing.WordIds(catalog.TOKENIZER).encode(text)
    expected = Tokenizer.from_file(catalog.TOKENIZER).encode(text, add_special_tokens=False).ids + [0]
    assert np.frombuffer(ids, "<u4").tolist() == expected


def test_word_ids_equal_those_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(packing, "_CACHED_WORDS", 50)
    words = packing.WordIds(catalog.TOKENIZER)
    tokenizer = Tokenizer.from_file(catalog.TOKENIZER)
    random.seed(2)
    signs = list("aAbßééΣΟΣς \t\n\r\v\f\x1c\x1f\x85  ​'’12$%&|🙂日本") + ["<|endoftext|>", "<|startoftext|>", "'s", " don't ", "fi", "İ", ".", ", ", ". ", "it's, ", "A1.", "e\u0301. ", "é!? ", "×, ", "÷. ", "it'. ", "%%% ", "É&& "]
    for _ in range(1500):
        text = "".join(random.choices(signs, k=random.randint(0, 40)))
        ids = np.frombuffer(words.encode(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [0], text


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_every_document_once(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 64, 2048])
    counts = Counter(min(size, int(rng.lognormvariate(3, 1.5)) + 1) for _ in range(rng.choice([1, 30, 5000])))
    bins = packing.plan_bins(dict(counts), size)
    held = Counter()
    for order, copies in bins:
        assert sum(order) <= size and copies > 0
        for length in order:
            held[length] += copies
    assert held == counts


def test_two_small_documents_replace_the_smallest():
    # greedy: 6 + 3 leaves 1 of 10; the 3 makes way for 2 + 2, which fill the gap of 4
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)


def test_bins_stay_near_the_bound():
    rng = random.Random(9)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(50_000))
    bins = packing.plan_bins(dict(counts))
    assert sum(c for _, c in bins) <= sum(k * n for k, n in counts.items()) / 2048 * 1.002 + 1
    assert len(bins) < 3 * 2048      # the plan follows the number of lengths


def test_rank_places_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 7)
    docs = spark.createDataFrame([(i % 900, "a b c d" if i % 3 else "x " * (i % 40)) for i in range(1000)], "doc_id long, text string")
    found = packing.pack(docs, catalog.TOKENIZER, 16).collect()
    assert Counter(tuple(r)[:5] for r in found) == plain_pieces([tuple(r) for r in docs.collect()], 16)
    total = sum(r["length"] for r in found)
    assert check_places(found, 16) <= total / 16 * 1.1 + 1
