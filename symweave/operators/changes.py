"""What changed between two states of a keyed table, and merging the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("path"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash"))


def detect(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, modified or removed; unchanged paths are left out. Both have path and content_hash."""
    joined = old.select("path", F.col("content_hash").alias("before")).join(new.select("path", F.col("content_hash").alias("after")), "path", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return joined.select("path", change.alias("change")).filter("change IS NOT NULL")


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """path of what is in both with different content."""
    return detect(old, new).filter("change = 'modified'").select("path")


def refs_to_resolve(refs: DataFrame, edges: DataFrame, changed_names: DataFrame, gone: DataFrame) -> DataFrame:
    """References that a change may resolve otherwise: those whose target is gone (edges: ref_id, target; gone: id), and those with a changed name (column name)."""
    lost = edges.join(gone.select(F.col("id").alias("target")), "target", "left_semi").select("ref_id")
    renamed = refs.join(changed_names.select(F.col("name").alias("reference_name")).distinct(), "reference_name", "left_semi").select("ref_id")
    return refs.join(lost.union(renamed).distinct(), "ref_id", "left_semi")
