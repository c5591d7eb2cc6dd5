"""A corpus pipeline: language identification, exact and near deduplication, masking of personal data, packing.

run() applies STAGES to the table documents. Each stage gets the spark session, the rows that the stage before it kept (written as
Parquet and read again) and the folder of the tables, and returns a DataFrame: documents with the columns they came with, and
the last one packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symweave.llm.exact_dedup import drop_copies
from symweave.llm.language_ppm import keep_identified, train
from symweave.llm.near_copies import drop_near_copies
from symweave.llm.pattern_packing import pack
from symweave.llm.pii_information import sanitise
from symweave.llm.shared import scratch, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or without a clear language go."""
    return keep_identified(docs, train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fingerprints, code lengths and token ids can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
