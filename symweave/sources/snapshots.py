"""Tables in shared folders: intermediate results, and versioned tables that change in part.

A versioned table is dealt into buckets by a hash of some of its columns. A new version writes the buckets that it touches and takes over all
others; its manifest, one small file that is written last, says in which version's folder each bucket lies. Readers see the old version or
the new one, never a mixture.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder of its own only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return made


_open: list[list[str]] = []


def stored(df: DataFrame, name: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here, and lost executors cost no recomputation.

    codec: how files are compressed, the session's way if None. The table goes when the innermost scratch() that is open ends (if it is to be kept, when the one around that ends), and with the application at
    the latest.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _with_file_system(spark, path, lambda fs, own: fs.deleteOnExit(own))
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _with_file_system(spark: SparkSession, path: str, do: Callable) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    do(own.getFileSystem(spark._jsc.hadoopConfiguration()), own)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were stored inside and are not kept; what is read later must not depend on them.

    Shuffle files of plans that are no longer referred to go, too, as the JVM collects them.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _with_file_system(spark, path, lambda fs, own: fs.delete(own, True))
        spark._jvm.java.lang.System.gc()


BUCKETS = 64
MANIFEST = "name string, bucket int, written long, buckets int, schema string"


class Change(NamedTuple):
    """What a version changes in a table.

    touched: rows with the columns `by`, whose buckets are written anew. rows: from what these buckets held (None before the first version) to what they
    shall hold, all of it rows of the same buckets. order: the order of rows in files. All versions of a table are dealt by the same columns; without
    any, it is one bucket.
    """

    touched: DataFrame
    by: tuple[str, ...]
    rows: Callable[[DataFrame | None], DataFrame]
    order: tuple[str, ...] = ()


def _bucket(by: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int") if by else F.lit(0)


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{MANIFEST}, version long").parquet(f"{root}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def current_version(spark: SparkSession, root: str) -> int:
    """The newest complete version; 0 if there is none."""
    found = _manifests(spark, root)
    return 0 if found is None else found.agg(F.max("version")).first()[0] or 0


def _manifest(spark: SparkSession, root: str, version: int) -> list:
    """Rows of a version: one for each bucket that holds rows, and one with bucket -1 for each table. As many as tables and buckets, whatever they hold."""
    found = _manifests(spark, root) if version else None
    return [] if found is None else found.filter(F.col("version") == version).collect()


def _read(spark: SparkSession, root: str, manifest: list, name: str, only: set[int] | None = None) -> DataFrame | None:
    schema = next((r.schema for r in manifest if r.name == name and r.bucket < 0), None)
    if schema is None:
        return None
    paths = [f"{root}/data/{name}/v{r.written}/_bucket={r.bucket}" for r in manifest if r.name == name and r.bucket >= 0 and (only is None or r.bucket in only)]
    typed = StructType.fromJson(json.loads(schema))
    return spark.read.schema(typed).parquet(*paths) if paths else spark.createDataFrame([], typed)


def read_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the newest by default; a column that came later is null in buckets that no version has touched since."""
    found = _read(spark, root, _manifest(spark, root, version or current_version(spark, root)), name)
    if found is None:
        raise ValueError(f"no table {name} under {root}")
    return found


def commit(spark: SparkSession, root: str, version: int, changes: dict[str, Change], buckets: int = BUCKETS) -> bool:
    """Writes a version: touched buckets of the changed tables, then its manifest. False, and nothing is done, if that version or a later one is complete.

    What a run that broke off has left of the version is replaced. A bucket is one file, or several where it is large; an empty one has none. The number
    of buckets is that of a table's first version. Tables without a change are taken over.
    """
    before = current_version(spark, root)
    if before >= version:
        return False
    old = _manifest(spark, root, before)
    rows = [tuple(r)[:5] for r in old if r.name not in changes]
    for name, change in changes.items():
        own = [r for r in old if r.name == name]
        n = own[0].buckets if own else buckets
        asked = {r[0] for r in change.touched.select(_bucket(change.by, n)).distinct().collect()}
        new = change.rows(_read(spark, root, old, name, asked))
        path = f"{root}/data/{name}/v{version}"
        placed = new.withColumn("_bucket", _bucket(change.by, n)).hint("rebalance", F.col("_bucket"))
        placed.sortWithinPartitions("_bucket", *change.order).write.mode("overwrite").partitionBy("_bucket").parquet(path)
        written = {int(d.partition("=")[2]) for d in _listed(spark, path) if d.startswith("_bucket=")}
        if written - asked:
            raise ValueError(f"rows of {name} outside the buckets that the change touches")
        rows += [(name, -1, version, n, new.schema.json())] + [(name, b, version, n, None) for b in sorted(written)]
        rows += [tuple(r)[:5] for r in own if r.bucket >= 0 and r.bucket not in asked]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return True


def _listed(spark: SparkSession, path: str) -> list[str]:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(own)) if fs.exists(own) else []


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest `keep` versions: their manifests first, then the buckets that no kept version refers to.

    To be called by whoever writes, between versions; a reader of an older version than those kept loses it. Only names of folders pass through the driver.
    """
    found = _manifests(spark, root)
    versions = [] if found is None else sorted((r[0] for r in found.select("version").distinct().collect()), reverse=True)[:keep]
    if not versions:
        return
    drop = lambda path: _with_file_system(spark, path, lambda fs, own: fs.delete(own, True))
    kept = {(r.name, r.written, r.bucket) for v in versions for r in _manifest(spark, root, v)}
    for folder in _listed(spark, f"{root}/manifest"):
        if folder.startswith("version=") and int(folder[8:]) < versions[-1]:
            drop(f"{root}/manifest/{folder}")
    for name in _listed(spark, f"{root}/data"):
        for folder in _listed(spark, f"{root}/data/{name}"):
            at = int(folder[1:])
            inside = [d for d in _listed(spark, f"{root}/data/{name}/{folder}") if d.startswith("_bucket=")]
            lost = [d for d in inside if (name, at, int(d[8:])) not in kept]
            if at > versions[0]:
                continue
            for path in [f"{root}/data/{name}/{folder}"] if len(lost) == len(inside) else [f"{root}/data/{name}/{folder}/{d}" for d in lost]:
                drop(path)
