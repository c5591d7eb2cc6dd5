"""An index that follows a stream of files equals the index of the files as they are in the end."""

from symweave.sources import snapshots
from symweave.streaming import sync

FIRST = {
    "src/app.ts": "import { Shown as Local } from './index';\nimport { helper } from './help';\nexport function run() {\n  Local();\n  helper();\n  late();\n}\n",
    "src/index.ts": "export { Hidden as Shown } from './deep';\n",
    "src/deep.ts": "export function Hidden() {\n}\n",
    "src/help.ts": "export function helper() {\n}\nexport class Store {\n  save(): void {\n  }\n}\n",
    "src/user.ts": "export function use(store) {\n  store.save();\n}\n",
}
SECOND = {"src/deep.ts": "// moved down\n\nexport function Hidden() {\n}\n", "src/late.ts": "export function late() {\n}\n", "src/help.ts": None}
THIRD = {"src/index.ts": "export { late as Shown } from './late';\n", "src/store.ts": "export class Store {\n  save(): void {\n  }\n}\nexport function helper() {\n}\n"}
SCHEMA = "path string, text string, modified_at int"


def rows(spark, tables):
    nodes = {r.id: f"{r.file_path}:{r.qualified_name}" for r in tables["nodes"].collect()}
    edges = sorted((nodes[r.source], nodes[r.target], r.kind, r.line, r.resolved_by) for r in tables["edges"].collect())
    words = [sorted(tuple(r[c] if c != "id" else nodes[r[c]] for c in columns) for r in tables[part].collect()) for part, columns in (("postings", ("term", "id", "length", "tf")), ("prefixes", ("word", "term")), ("runs", ("gram", "name")), ("totals", ("n", "tokens")))]
    return words, sorted(nodes.values()), edges, sorted(r.ref_id for r in tables["refs"].collect()), sorted((r.path, r.text) for r in tables["files"].collect())


def test_an_index_that_follows_equals_one_made_at_once(spark, tmp_path):
    root = str(tmp_path / "state")
    for k, batch in enumerate((FIRST, SECOND, THIRD)):
        spark.createDataFrame([(p, t, k) for p, t in batch.items()], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sync.follow_index(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), root, str(tmp_path / "check")).awaitTermination()
        if k == 0:
            targets = {t for _, t, *_ in rows(spark, {n: snapshots.read_snapshot(spark, root, n) for n in sync.INDEX})[2]}
            assert {"src/deep.ts:Hidden", "src/help.ts:helper", "src/help.ts:Store::save"} <= targets and not any("late" in t for t in targets)
    final = {p: t for p, t in (FIRST | SECOND | THIRD).items() if t is not None}
    at_once = rows(spark, sync.reindex(None, spark.createDataFrame([(p, t, 0) for p, t in final.items()], SCHEMA)))
    followed = rows(spark, {n: snapshots.read_snapshot(spark, root, n) for n in sync.INDEX})
    assert followed == at_once
    assert set(sync.search_index(spark, root).postings.columns) == {"term", "id", "length", "tf"}
    unchanged = {n: df.count() for n, (_, df) in sync.changes({n: snapshots.read_snapshot(spark, root, n) for n in sync.INDEX}, spark.createDataFrame([(p, t, 9) for p, t in final.items()], SCHEMA)).items()}
    assert unchanged == {n: int(n == "totals") for n in sync.INDEX}
    assert {("src/late.ts:late", "import"), ("src/store.ts:Store::save", "instance-method")} <= {(t, by) for _, t, _, _, by in followed[2]}
