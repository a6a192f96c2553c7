"""Token counts against the tokenizers package on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from msgrisk.llm import token_counts

from tests.llm.conftest import ODD_ROWS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
PARTS = ["word", " ", "  ", "\n", " \n", "\n ", "\t", "'s", "'ll", "'", "l", "don't", "123", ".", "!?", "<|endoftext|>", "<|endof", "text|>", "é", "日本", "🙂", " ", " ", "\x1c", "\x85", "᠎", "é", "A", "zz"]


def n_tokens(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


def expected(rows):
    return sorted(((i, len((t or "").encode()), n_tokens(t), n_tokens(t) > 1024) for i, t in rows), key=str)


def counted(docs, **sizes):
    return sorted((tuple(r) for r in token_counts.token_counts(docs, PATH, **sizes).collect()), key=str)


def test_words_are_counted_apart():
    draw, counter = random.Random(3), token_counts.Counter(PATH)
    assert counter.known
    for _ in range(5000):
        text = "".join(draw.choices(PARTS, k=draw.randint(0, 12)))
        assert counter.count(text) == n_tokens(text), repr(text)


@pytest.mark.parametrize("chunk, overlap", [(40, 20), (64, 40), (200, 64)])
def test_spliced_chunks_of_odd_texts(spark, chunk, overlap):
    draw = random.Random(chunk)
    rows = [(i, "".join(draw.choices(PARTS, k=draw.randint(50, 300)))) for i in range(60)]
    rows += [(100, "a" * 3000), (101, "word " * 500), (102, " " * 2000), (103, "'" * 999 + "ll"), (104, "<|endoftext|>" * 100), (105, "x" * 700 + " and words " * 50 + "y" * 900)]
    assert counted(documents(spark, rows), chunk=chunk, overlap=overlap) == expected(rows)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    assert counted(odd_docs) == expected(ODD_ROWS)
    assert counted(no_docs) == []


def test_other_kinds_of_tokenizer(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = [(1, "Some Words and MORE words " * 50), (2, "short"), (3, None)]
    found = token_counts.token_counts(documents(spark, rows), path, chunk=100)
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_the_query_on_whole_documents(spark, sf_dir):
    from msgrisk.llm import catalog

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in catalog.QUERIES["op12_token_counts"](spark, sf_dir).collect()), key=str) == expected(rows)
    assert counted(docs, chunk=500, overlap=100) == expected(rows)
