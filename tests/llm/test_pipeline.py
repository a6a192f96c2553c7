"""The pipeline against a plain version of its stages."""

import re
from collections import Counter

import corpus_pipeline
import __spark_entry__
from msgrisk.llm import catalog, quality
from tests.llm.conftest import documents
from tests.llm.test_decontaminate import best_window, words
from tests.llm.test_near_duplicates import groups, plain_fingerprint
from tests.llm.test_packing import check_places, plain_pieces
from tests.llm.test_scans import SECRETS


def plain_redaction(text):
    spans = sorted((m.start(), m.end()) for _, p, ok in SECRETS for m in re.finditer(p, text or "", re.ASCII) if ok(m))
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return text if not spans else out + text[at:]


def test_pipeline_of_the_whole_table(spark, sf_dir):
    model = quality.learn(
        catalog.table(spark, sf_dir, "documents"), catalog.table(spark, sf_dir, "labels"), ~catalog.held_out(3, 1)
    )
    rows = [(r.doc_id, r.text) for r in catalog.table(spark, sf_dir, "documents").collect()]
    rows = [(i, t) for i, t in rows if model.probability(t, "1") >= 0.5]
    named = groups([plain_fingerprint(t) for _, t in rows], [i for i, _ in rows])
    rows = [r for r, g in zip(rows, named) if r[0] == g]
    items = [words(r.text) for r in catalog.table(spark, sf_dir, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not any(best_window(words(t), item) >= 0.8 for item in items)]
    rows = [(i, plain_redaction(t)) for i, t in rows]
    found = __spark_entry__.queries()["pipeline"](spark, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in found) == plain_pieces(rows)
    check_places(found, 2048)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        docs = out
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_of_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    model = quality.learn(odd_docs, catalog.table(spark, sf_dir, "labels"), ~catalog.held_out(3, 1))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.keep_good(spark, odd_docs, sf_dir).collect()]
    assert Counter(kept) == Counter(r for r in rows if model.probability(r[1], "1") >= 0.5)
    places = corpus_pipeline.packed(spark, odd_docs, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in places) == plain_pieces(rows)
    check_places(places, 2048)
    assert corpus_pipeline.keep_good(spark, no_docs, sf_dir).collect() == [] == corpus_pipeline.packed(spark, no_docs, sf_dir).collect()


def test_columns_that_stages_use_inside_stay(spark, sf_dir):
    """Names, types, order and values of clashing columns, through every stage that returns documents."""
    kinds = "_key string, _print string, blob int, spans string, quality_score string, found int, component long, set_apart_0 int, k double, place int"
    rows = [(i, t, "key", "print", 7, "spans", "score", 8, 9, 10, 0.5, 11) for i, t in [(1, "plain prose of one kind, and words"), (2, None), (None, "more words of prose here")]]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {kinds}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema, name
        assert {tuple(r)[2:] for r in out.collect()} <= {rows[0][2:]}, name
        if name != "quality":
            assert out.count() == 3, name


def test_secrets_stage_replaces_secrets(spark, sf_dir):
    docs = documents(spark, [(1, "my token = abcdefghijklmnop"), (2, "clean"), (3, None)])
    rows = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, sf_dir).collect()}
    assert rows[1].text == "my [secret]" and rows[1].n_chars == 11
    assert rows[2].text == "clean" and rows[3].text is None
