"""Changes to tables as set operations: the new table is returned, and written by whoever holds the snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import REQUIRED, Graph


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, that which comes last in the order."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(o) if isinstance(o, str) else o.desc() for o in order))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that have all required columns."""
    return nodes.filter(reduce(Column.__and__, [F.col(c).isNotNull() & (F.col(c) != "") for c in REQUIRED]))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with rows of new in the place of those with equal keys. Keys of new must be unique."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns)


def delete_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without the nodes of gone (column id) and without their edges."""
    edges = graph.edges
    for end in ("source", "target"):
        edges = delete(edges, gone.select(F.col("id").alias(end)), [end])
    return Graph(delete(graph.nodes, gone, ["id"]), edges)


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """The graph without the nodes of files (column file_path), and their edges."""
    return delete_nodes(graph, graph.nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi"))


def sound_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges.select("source", "target", *(c for c in edges.columns if c not in ("source", "target")))


def put_metadata(metadata: DataFrame, key: str, value: str) -> DataFrame:
    """metadata (key, value) with the key set to the value."""
    return upsert(metadata, metadata.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def metadata_map(metadata: DataFrame) -> DataFrame:
    """One row with a map of all keys, which are few: settings and times of the index."""
    return metadata.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def clear(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without rows, to be written as the next snapshot."""
    return {name: df.limit(0) for name, df in tables.items()}
