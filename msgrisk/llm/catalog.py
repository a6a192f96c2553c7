"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgrisk.llm import (
    centroids, decontaminate, embeddings, language, lexical_search, packing, pii, quality, secret_scan, simhash, token_counts, toxicity, warc,
)
from msgrisk.llm.shared import fold, prepare, scratch
from msgrisk.llm.sql import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(function: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int):
    return fold(F.col("doc_id"), modulus) == remainder


@query
def op1_simhash_near_duplicates(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op3_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    rows = toxicity.scored(docs.select("doc_id", "text"), lexicon)
    return rows.select(
        "doc_id", held_out(3, 1).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op5_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = secret_scan.secrets(docs, scratch(spark, "ledger")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id", *map(count, secret_scan.BASE_KINDS), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans")
    )


@query
def op6_warc_pages(spark, sf_dir):
    path = scratch(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return warc.read_records(spark, path, columns, verify=True)


@query
def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")


@query
def op8_embedding_near_duplicates(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    rows = quality.scored(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", held_out(3, 1).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, ~held_out(4, 2))
    rows = language.identified(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(4, 2).alias("held_out"), "language.lang_pred", "language.score")


@query
def op11_centroid_clusters(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


@query
def op12_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


@query
def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
