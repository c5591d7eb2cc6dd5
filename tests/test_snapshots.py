"""Versioned tables: what a version writes follows what it changes, whatever the table holds."""

from pathlib import Path

from pyspark.sql import functions as F
from symweave.operators.mutate import upsert
from symweave.sources.snapshots import Change, commit, current_version, read_snapshot, vacuum
from symweave.streaming import sync

STATE = "path string, n long, text string"


def put(new):
    return {"t": Change(new, ("path",), lambda old: new if old is None else upsert(old, new, ["path"]), ("path",))}


def held(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_a_version_writes_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path / "state")
    many = spark.range(3000).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    assert commit(spark, root, 1, put(many), 32)
    first = held(root)
    one = spark.createDataFrame([("p7", -7, "x"), ("new", None, None)], STATE)
    assert commit(spark, root, 2, put(one), 5)  # the number of buckets is that of the first version
    second = {p: t for p, t in held(root).items() if p not in first}
    assert len([p for p in second if p.startswith("data")]) <= 2 and all(held(root)[p] == t for p, t in first.items())
    size = lambda paths: sum((Path(root) / p).stat().st_size for p in paths if p.startswith("data"))
    assert size(second) < size(first) / 8
    now = {r.path: r.n for r in read_snapshot(spark, root, "t").collect()}
    assert now == {f"p{k}": k for k in range(3000)} | {"p7": -7, "new": None}
    assert read_snapshot(spark, root, "t", 1).filter("n = 7").count() == 1
    before = held(root)
    assert not commit(spark, root, 2, put(one)) and held(root) == before  # run again after it was complete


def test_a_run_that_broke_off_is_replaced_and_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "state")
    rows = lambda *r: spark.createDataFrame(list(r), STATE)
    commit(spark, root, 1, put(rows(("a", 1, "x"), ("b", 1, "y"), (None, 0, ""))), 8)
    rows(("z", 9, "half")).withColumn("_bucket", F.lit(3)).write.partitionBy("_bucket").parquet(f"{root}/data/t/v2")  # no manifest: not there
    assert current_version(spark, root) == 1 and read_snapshot(spark, root, "t").count() == 3
    vacuum(spark, root, 1)
    commit(spark, root, 2, put(rows(("a", 2, "x"))))
    commit(spark, root, 3, put(rows(("a", 3, "x"))) | {"empty": Change(rows().select("n"), (), lambda old: rows().select("n"))})
    vacuum(spark, root, 1)
    assert current_version(spark, root) == 3 and sorted(p.name for p in Path(root, "manifest").iterdir()) == ["version=3"]
    assert sorted((r.path or "", r.n) for r in read_snapshot(spark, root, "t").collect()) == [("", 0), ("a", 3), ("b", 1)]
    assert not Path(root, "data/t/v2").exists()
    assert read_snapshot(spark, root, "empty").count() == 0 and read_snapshot(spark, root, "empty").columns == ["n"]
    gone = rows(("a", 0, None), ("b", 0, None), (None, 0, None)).select("path")
    commit(spark, root, 4, {"t": Change(gone, ("path",), lambda old: old.limit(0))})
    assert read_snapshot(spark, root, "t").count() == 0 and read_snapshot(spark, root, "empty").count() == 0


def test_new_columns_and_rows_out_of_place(spark, tmp_path):
    root = str(tmp_path / "state")
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "path string, _n long")
    commit(spark, root, 1, put(old), 16)
    wider = spark.createDataFrame([("a", 2, "more")], "path string, _n long, extra string")
    commit(spark, root, 2, {"t": Change(wider, ("path",), lambda kept: kept.join(wider, "path", "left_anti").unionByName(wider, allowMissingColumns=True))})
    assert sorted(tuple(r) for r in read_snapshot(spark, root, "t").collect()) == [("a", 2, "more"), ("b", 1, None), ("c", 1, None), ("d", 1, None)]
    try:
        commit(spark, root, 3, {"t": Change(wider.limit(0), ("path",), lambda kept: wider)})
    except ValueError:
        assert current_version(spark, root) == 2
    else:
        raise AssertionError("rows outside the touched buckets were written")


def test_what_a_stream_writes_follows_its_batches(spark, tmp_path):
    code = lambda k: f"export function f{k}() {{\n  g{k}();\n}}\nexport function g{k}() {{\n}}\n"
    schema = "path string, text string, modified_at int"
    root = str(tmp_path / "state")
    for k, batch in enumerate(([(f"src/a{i}.ts", code(i), 0) for i in range(200)], [("src/a5.ts", code(5) + "\n", 1)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sync.follow_index(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), root, str(tmp_path / "check"), buckets=32).awaitTermination()
    rewritten = {name: sum(1 for _ in Path(root, "data", name, "v2").glob("_bucket=*")) if Path(root, "data", name, "v2").exists() else 0 for name in sync.INDEX}
    assert rewritten == {"files": 1, "nodes": 1, "refs": 1, "edges": 1, "postings": 1, "prefixes": 0, "runs": 0, "totals": 1}
