"""Sharding along a Hilbert curve over quantised metadata.

Language, source and length are quantised to BITS bits each and joined into a Hilbert index. Sorted by it, rows that are
near each other in all dimensions lie together, so cutting the order into runs gives files whose minima and maxima prune
scans in every dimension. Cells keep the order of their values and hold about as many rows each, so a file's range of cells is a narrow range of values.
Law `rows`: the runs' row counts are at most one apart. Equal texts are not kept together: the curve decides, and copies that differ in
language or source may be in different shards.

Only keys, sizes and checksums are stored and sorted; texts are read once and not shuffled. The order is a range partitioning by
(index, doc_id, checksum, size), so a third of all rows with one index still spreads over many tasks. Ranks are a
task's offset plus the place within the task; the driver sees one count for each task, and the lower bound of each cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, scratch, stored

BITS, SHARDS, AXES = 8, 24, ("lang", "source", "chars")


def hilbert_index(axes: Sequence[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of points with coordinates below 2 ** bits (Skilling 2004: axes to transposed index)."""
    x = [np.asarray(a, np.int64).copy() for a in axes]
    steps = [1 << b for b in range(bits - 1, 0, -1)]
    for q in steps:
        for i in range(len(x)):
            inverts = x[i] & q != 0
            swap = np.where(inverts, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inverts, q - 1, swap)
            x[i] ^= swap if i else 0
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in steps:
        turn ^= np.where(x[-1] & q, q - 1, 0)
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = index << 1 | (a ^ turn) >> b & 1
    return index


def cell_bounds(rows: DataFrame, name: str, cells: int = (1 << BITS) - 1) -> list[tuple[int, object]]:
    """(cell, least value) of the at most so many cells that hold values, in order; a value's cell follows from how many rows have lesser ones."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task)), pa.array(before + np.cumsum(n) - n)], ["value", "n", "task", "before"])
            before += n.sum()

    values = rows.select(F.col(name).alias("value")).filter("value IS NOT NULL")
    counts = stored(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "values")
    schema = counts.schema.add("task", "long").add("before", "long")
    ranked = stored(counts.repartitionByRange("value").sortWithinPartitions("value").mapInArrow(summed, schema), "ranked")
    totals = sorted(ranked.groupBy("task").agg(F.sum("n").alias("n")).collect())  # a row for each task of the sort
    if not totals:
        return []
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    start = F.element_at(F.create_map(*(F.lit(x) for (task, _), s in zip(totals, starts, strict=False) for x in (task, s))), F.col("task"))
    cell = F.floor((start + F.col("before")) * cells / starts[-1])
    return sorted((r.cell + 1, r.least) for r in ranked.groupBy(cell.alias("cell")).agg(F.min("value").alias("least")).collect())


def hilbert_column(bounds: Sequence[list[tuple[int, object]]], *axes: Column) -> Column:
    """The index of rows with values for each of bounds. A null has cell 0."""
    tables = [(np.array([0, *(c for c, _ in b)]), np.array([v for _, v in b], object)) for b in bounds]

    @F.pandas_udf("long")
    def index(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        def cells(values: pd.Series, numbers: np.ndarray, least: np.ndarray) -> np.ndarray:
            known = values.notna().to_numpy()
            place = np.zeros(len(values), np.int64)
            place[known] = np.searchsorted(least, values[known].to_numpy(object), "right")
            return numbers[place]

        return pd.Series(hilbert_index([cells(x, *t) for x, t in zip((a, b, c), tables, strict=True)]))

    return index(*axes)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "task", "place"])
        at += n


def along_the_curve(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, task, place: the rows' places in the order of the curve."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.length("text").alias("chars"),
    ), "keys")
    bounds = [cell_bounds(rows, c) for c in AXES]
    rows = rows.select("doc_id", "size", "text_crc32", hilbert_column(bounds, *map(F.col, AXES)).alias("hilbert"))
    order = ["hilbert", "doc_id", "text_crc32", "size"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_placed, "doc_id long, size long, text_crc32 long, hilbert long, task long, place long")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert for each row of docs (doc_id, text, lang, source).

    Null texts count as empty (size 8, checksum 0); null labels and texts have a cell of their own. Ties of the index go by doc_id
    (nulls first), checksum and size; rows alike in all of these are interchangeable and each get a slot. Other columns are
    ignored. An empty table gives an empty result; with fewer rows than shards the last shards stay empty.
    """
    with scratch(docs.sparkSession):
        placed = stored(along_the_curve(docs), "hilbert", keep=True)
    counts = sorted(placed.groupBy("task").count().collect())  # a row for each task of the sort
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    offsets = docs.sparkSession.createDataFrame([(task, start) for (task, _), start in zip(counts, starts, strict=False)], "task long, start long")
    least, larger = divmod(starts[-1], shards)
    rank = F.col("start") + F.col("place")
    cut = larger * (least + 1)
    shard = F.when(rank < cut, F.floor(rank / (least + 1))).otherwise(larger + F.floor((rank - cut) / max(least, 1)))
    first = F.col("shard") * least + F.least(F.col("shard"), F.lit(larger))
    return (
        placed.join(F.broadcast(offsets), "task").withColumn("shard", shard.cast("int"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (rank - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes docs as Parquet, a folder for each shard, sorted along the curve. Null texts and labels are written as they are, and an empty table gives no folder.

    Rows without a doc_id or with a repeated one are refused, as the plan is joined by it. A column called shard, _shard or _slot would clash.
    """
    placed = hilbert_shards(docs, shards).select("doc_id", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    if not placed.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        raise ValueError("doc_id must be unique and not null")
    joined = docs.join(placed, "doc_id").repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    joined.drop("_slot").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))
