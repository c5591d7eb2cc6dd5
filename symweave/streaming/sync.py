"""Keeping tables in step with a stream of files, batch by batch.

Micro-batches are single-flight and each writes the buckets that it touches as a version numbered by its batch id: a batch that is run again after a
failure replaces what it left, and one whose version is complete does nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import extract, imports, index
from ..operators.mutate import latest, upsert
from ..operators.resolve import resolve
from ..sources.snapshots import BUCKETS, Change, commit, current_version, read_snapshot, scratch, shared_dir, stored, vacuum

INDEX = ("files", "nodes", "refs", "edges", *index.PARTS)
#: table, columns that deal its rows into buckets, columns by which rows go (of none, all go), order in files
LAYOUT = {
    "files": (("path",), ("path",), ("path",)),
    "nodes": (("file_path",), ("file_path",), ("name",)),
    "refs": (("file_path",), ("file_path",), ("reference_name",)),
    "edges": (("file_path",), ("ref_id",), ("source",)),
    "postings": (("file_path",), ("id",), ("term",)),
    "prefixes": (("term",), ("term",), ("word",)),
    "runs": (("name",), ("name",), ("gram",)),
    "totals": ((), (), ()),
}


def follow(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], keys: tuple[str, ...], root: str, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS):
    """Starts a query that merges each batch into the versions of the table `state` under root.

    State is dealt by keys, columns of stream and state: merge sees what the buckets of the batch's keys hold, and the batch, and only these are written.
    A root belongs to one checkpoint, whose batch numbers are its versions.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        commit(batch.sparkSession, root, batch_id + 1, {"state": Change(batch, keys, lambda old: merge(old, batch))}, buckets)
        vacuum(batch.sparkSession, root)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow_index(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS):
    """Starts a query that keeps the tables of INDEX under root in step with a stream of files (path, text, modified_at); a null text removes the path."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if (before := current_version(spark, root)) > batch_id:
            return
        with scratch(spark):
            old = {name: read_snapshot(spark, root, name, before) for name in INDEX} if before else None
            steps = changes(old, latest(batch, ["path"], ["modified_at", "text"]))
            commit(spark, root, batch_id + 1, {name: _change(name, *steps[name]) for name in INDEX}, buckets)
        vacuum(spark, root)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _change(name: str, gone: DataFrame | None, fresh: DataFrame) -> Change:
    by, keys, order = LAYOUT[name]
    touched = fresh.select(*by) if gone is None or not by else gone.select(*by).union(fresh.select(*by))

    def rows(old: DataFrame | None) -> DataFrame:
        if old is None or gone is None or not keys:
            return fresh
        return old.join(gone.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)

    return Change(touched, by, rows, order)


def search_index(spark: SparkSession, root: str) -> index.Index:
    """The search index of the newest version under root."""
    version = current_version(spark, root)
    tables = {part: read_snapshot(spark, root, part, version) for part in index.PARTS}
    return index.Index(**(tables | {"postings": tables["postings"].drop("file_path")}))


def reindex(old: dict[str, DataFrame] | None, batch: DataFrame) -> dict[str, DataFrame]:
    """The tables of INDEX after a batch of files (path, text; each path once)."""
    return {name: _change(name, *step).rows(old and old[name]) for name, step in changes(old, batch).items()}


def changes(old: dict[str, DataFrame] | None, batch: DataFrame) -> dict[str, tuple[DataFrame | None, DataFrame]]:
    """What a batch of files (path, text; each path once) changes in the tables of INDEX, as (keys that go, rows that come): files, their nodes and references, the edges
    from resolved references, and the search index of the nodes.

    A file whose text is what it was changes nothing. Only other files of the batch are read for symbols. Resolved anew are their references, those that led to a symbol of the batch's
    files before, those that speak of a name in them, old or new, and, where files of the batch pass on names of others, those to imported names.
    """
    if old is not None:
        known = old["files"].select("path", F.sha2("text", 256).alias("_known"))
        batch = batch.join(known, "path", "left").filter(~F.sha2("text", 256).eqNullSafe(F.col("_known"))).drop("_known")
    typed = stored(batch.withColumn("language", extract.language_of(F.col("path"), F.col("text"))), "batch")
    paths = typed.select("path").distinct()
    live = typed.filter("text IS NOT NULL").select("path", "language", "text")
    found = stored(extract.symbols(live), "symbols")
    nodes = stored(extract.file_nodes(live).unionByName(found, allowMissingColumns=True), "fresh")
    refs = extract.references(live, found)
    refs = stored(refs.withColumn("ref_id", F.sha2(F.concat_ws("\u0001", "from_node_id", "reference_kind", "reference_name", F.col("line").cast("string")), 256)).distinct(), "references")
    if old is None:
        made = index.build(nodes)._asdict()
        made |= {"postings": index.placed(made["postings"], nodes)}
        return {name: (None, df) for name, df in ({"files": live, "nodes": nodes, "refs": refs, "edges": stored(_resolved(refs, live, nodes), "edges")} | made).items()}
    others = lambda df, path: df.join(paths.withColumnRenamed("path", path), path, "left_anti").select(*df.columns)
    gone = paths.select(F.col("path").alias("file_path"))
    before = old["nodes"].join(gone, "file_path", "left_semi")
    touched = before.select("id", "name").union(nodes.select("id", "name"))
    names = touched.select(F.explode(F.array(F.lower("name"), F.regexp_replace(F.lower("name"), F.lit(r"\.\w+$"), F.lit("")))).alias("name")).distinct()
    files, after, kept = others(old["files"], "path").unionByName(live), others(old["nodes"], "file_path").unionByName(nodes, allowMissingColumns=True), others(old["refs"], "file_path")
    lost = old["edges"].join(before.select(F.col("id").alias("target")), "target", "left_semi").select("ref_id")
    spoken = kept.select("ref_id", F.explode(F.split(F.lower("reference_name"), r"[.:/\\]+")).alias("name")).join(names, "name", "left_semi").select("ref_id")
    passing = not imports.reexports(old["files"].join(paths, "path", "left_semi").unionByName(live)).isEmpty()
    imported = imports.mappings(others(old["files"], "path")).select(F.col("path").alias("file_path"), "local").distinct()
    through = kept.withColumn("local", F.split_part("reference_name", F.lit("."), F.lit(1))).join(imported, ["file_path", "local"], "left_semi").filter(F.lit(passing)).select("ref_id")
    again = kept.join(lost.union(spoken).union(through).distinct(), "ref_id", "left_semi")
    asked = stored(again.unionByName(refs), "asked")
    left = asked.select("file_path", "ref_id").union(old["refs"].join(gone, "file_path", "left_semi").select("file_path", "ref_id")).distinct()
    steps = {
        "files": (paths, live),
        "nodes": (gone, nodes),
        "refs": (gone, refs),
        "edges": (left, stored(_resolved(asked, files, after), "edges")),
    }
    parts = index.Index(*(old[part] for part in index.PARTS))
    return steps | index.changed(parts, old["nodes"], before, nodes, after)


def _resolved(refs: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref_id, source, target, kind, line, confidence, resolved_by, file_path of the references that resolve."""
    hits = resolve(refs, nodes, imported=lambda r: imports.by_import(r, files, nodes))
    return hits.join(refs.select("ref_id", F.col("from_node_id").alias("source"), F.col("reference_kind").alias("kind"), "line", F.col("file_path").alias("_file")), "ref_id").select("ref_id", "source", "target", "kind", "line", "confidence", "resolved_by", F.col("_file").alias("file_path"))


def merge_files(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Files (path, content_hash, modified_at): the latest of each path; a null content_hash removes the path."""
    new = latest(batch, ["path"], ["modified_at", "content_hash"])
    merged = new if old is None else upsert(old, new, ["path"])
    return merged.filter("content_hash IS NOT NULL")


def merge_counts(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """event_type, n, total: counts and exact sums so far."""
    now = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))
    both = now if old is None else old.unionByName(now)
    return both.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"))


def event_totals(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """event_type, n, total of the events table, read as a stream to its end."""
    import uuid

    base = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    follow(stream, merge_counts, ("event_type",), f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return read_snapshot(spark, f"{base}/state", "state").select("event_type", "n", F.col("total").cast("double").alias("total"))


QUIET = "project string, n long, first_at timestamp, last_at timestamp"


def debounced(changes: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """project, n, first_at, last_at: one row for each burst of a stream of changes (project, at), once a project has been quiet for quiet_ms.

    A change within that time puts the row off. The state of a project is a count and two times, whatever the burst; the timer is one of processing time, so
    the query needs a trigger that goes on. Null times do not count as first or last; changes without a project are one project.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, first, last = state.get
            state.remove()
            yield pd.DataFrame({"project": [key[0]], "n": [n], "first_at": [pd.Timestamp(first)], "last_at": [pd.Timestamp(last)]})
            return
        n, first, last = state.get if state.exists else (0, None, None)
        for rows in batches:
            times = [t for t in [first, last, *(x.to_pydatetime() for x in rows["at"].dropna())] if t is not None]
            n, first, last = n + len(rows), min(times, default=None), max(times, default=None)
        state.update((n, first, last))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({c.split()[0]: [] for c in QUIET.split(", ")})

    return changes.select("project", "at").groupBy("project").applyInPandasWithState(step, QUIET, "n long, first_at timestamp, last_at timestamp", "append", GroupStateTimeout.ProcessingTimeTimeout)
