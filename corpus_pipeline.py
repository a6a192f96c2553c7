"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's
documents.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from msgrisk.llm import catalog, decontaminate, packing, quality, secret_scan, simhash
from msgrisk.llm.shared import keep, prepare, scratch, set_apart


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones among them, does not reject.

    Null, empty and blank texts are judged as one such text; long texts are read whole; repeated rows fare alike;
    without labelled rows of both kinds every document stays, and an empty table stays empty.  Columns of any
    name stay as they are."""
    prepare(spark)
    inner, restored = set_apart(docs, "doc_id", "text")
    model = quality.learn(inner, catalog.table(spark, sf_dir, "labels"), ~catalog.held_out(3, 1))
    return restored(quality.scored(inner, model).where(F.col("quality_score") >= 0.5))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id, of each group of linked fingerprints.

    Null, empty and blank texts are one group; rows without doc_id and repeated ids are judged by their texts
    (``simhash.one_row_of_each_group``).  Columns of any name stay as they are."""
    prepare(spark)
    return simhash.one_row_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark passage; each is judged by its own text, searched whole.

    Null and empty texts, repeated rows and rows without doc_id stay unless their text holds one.  Columns of any
    name stay as they are."""
    prepare(spark)
    return decontaminate.clean_rows(docs, catalog.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars, if there is one, follows the text.

    Null and empty texts hold none and stay as they are; every row of a repeated text is redacted; long texts are
    scanned whole.  Columns of any name stay as they are."""
    prepare(spark)
    inner, restored = set_apart(docs, "doc_id", "text", "n_chars")
    found = secret_scan.secrets(inner, scratch(spark, "ledger"))
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return restored(clean)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in training sequences (``packing.pack``).

    Null and empty texts have their closing id only; long ones are cut into pieces; repeated rows and rows
    without doc_id are packed like others.  The columns are those of the places, others are left out."""
    prepare(spark)
    return packing.pack(docs, catalog.TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", redact_secrets),
    ("packing", packed),
]

# Tokenizers and a trained classifier are no work for SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
