"""Small helpers the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from msgrisk.session import apply_settings, checkpoint_root

MOST_LABELS = 10_000    # values of a label whose sizes are broadcast, a few bytes each
BROADCAST_ROWS = 200_000    # rows of a few numbers, up to about 150 bytes each in a broadcast, that Spark may choose to broadcast
BATCH_ROWS = 1000       # texts that a Python worker holds at once; Spark bounds the bytes of a batch as well


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the corpus operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return apply_settings(spark)


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later passes survive a lost executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the ``used`` ones under names that no operator has, and a function that selects
    them again from a table made of it, under their own names and in their order."""
    names = [c if c in used else f"set_apart_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda rows: rows.select(*names).toDF(*docs.columns)


def regrouped(key: Column) -> Column:
    """A one-to-one image of a long key.

    A join on the image shuffles both sides anew, also one that is grouped by the key already; only such
    joins are split by adaptive execution when a key is hot.
    """
    return key.bitwiseXOR(F.lit(1).cast("long"))


def unless_many(side: DataFrame, n: int) -> DataFrame:
    """``side`` of a join, both of which are shuffled if ``n``, a bound on the rows that might be broadcast, is large.

    Else Spark chooses.  It goes by bytes, which it takes from files however well they are compressed and which
    leave out what an explode adds, so it may send a table to the driver that has no room for it.
    """
    return side.hint("merge") if n > BROADCAST_ROWS else side


def broadcast_if_few(side: DataFrame, n: int) -> DataFrame:
    """``side`` of a join, broadcast if ``n``, a bound on its rows, is small: Spark may take the other side, of wide
    rows, to be smaller.  Else both are shuffled."""
    return unless_many(side, n) if n > BROADCAST_ROWS else F.broadcast(side)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo: decides which rows a model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, usable: Column) -> pd.DataFrame:
    """Columns doc_id, text, label: the ``per_class`` usable rows of each value of a label with the least
    id hash.  The bound keeps a fit the same size whatever the corpus holds.

    Rows without id, text or label are left out; of repeated labels the least counts, of repeated documents the
    one with the least text.  Very long texts are taken whole.  Empty tables give no rows.  The driver gets at most
    ``per_class`` rows of each label, however often an id is repeated.
    """
    wanted = (
        labels.select("doc_id", F.col(label).cast("string").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    known = docs.where(F.col("text").isNotNull()).select("doc_id").where(usable)
    wanted = keep(wanted.join(known, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")))
    # Hashes are spread evenly: four times the rows wanted are below this bound.  The sizes of the labels are
    # broadcast, so the bound holds before any row is shuffled, and only the rows below it are ranked.
    sizes = wanted.groupBy("label").agg(F.count("*").alias("n"))
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_LABELS else sizes
    bound = F.least(F.lit(1.0), F.lit(4.0 * per_class) / F.col("n")) * 2.0**64 - 2.0**63
    few = wanted.join(sizes, "label").where(F.col("h").cast("double") <= bound)
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    chosen = few.withColumn("place", place).where(F.col("place") <= per_class).select("doc_id", "label").toPandas()
    if chosen.empty:
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "text": pd.Series(dtype=str), "label": pd.Series(dtype=str)})
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen[["doc_id"]].astype("int64"), "doc_id long"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).toPandas()
    return texts.merge(chosen[["doc_id", "label"]].astype({"doc_id": "int64"}), on="doc_id").sort_values("doc_id").reset_index(drop=True)
