"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import scratch, stored

__all__ = ["SPACES", "crc32_of_id", "documents", "held_out", "scratch", "small_batches", "stored", "text_key", "without"]

#: ASCII white space: what separates words in every contract of this subpackage.
SPACES = " \t\n\x0b\x0c\r"


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands Python batches of 4 MB or 500 rows at most, so that tasks hold few long texts at a time."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        df.sparkSession.conf.set(key, str(most))
    return df


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as decimal text; decides held-out rows (mod 3 is 1) without a draw of random numbers."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(doc_id) % 3 == 1, F.lit(False))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """What tells a row's text from others under the same doc_id: its SHA-256, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text stand in gone, and with one of those whose doc_id and text stand in repeated.

    gone and repeated: doc_id, text_key. They grow with the corpus, so they are never broadcast: texts move once, at every size. doc_ids compare null-safely. Of repeated rows that differ in other columns the least stays, by
    column after column. All columns stay as they were; only rows with a key in repeated are shuffled whole, each task's least of them.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text_key().alias("_key"))

    def among(keys: DataFrame, how: str) -> DataFrame:
        own = keys.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).hint("merge")
        return rows.join(own, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), how)

    left = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if repeated.isEmpty():
        return among(gone, "left_anti").select(*left)
    once = among(repeated, "left_semi").groupBy("_doc", "_key").agg(F.min("_row").alias("_row"))
    once = stored(once.select(*left), "once", keep=True)
    return among(stored(gone.union(repeated), "gone", keep=True), "left_anti").select(*left).union(once)
