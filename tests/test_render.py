"""Answers, impacts and trees of files as text, and the plainer answer against plain Python."""

import json as j

from pyspark.sql import functions as F

from symweave.functions.text import question_symbols
from symweave.operators import context, render
from tests.test_answer import TEXT, small


def plain_tree(paths, most=None):
    root = {}
    for path in paths:
        at = root
        for part in filter(None, (path or "").split("/")):
            at = at.setdefault(part, {})
    files, lines = {tuple(filter(None, p.split("/"))) for p in paths if p}, []

    def walk(at, way, bars):
        if most is not None and len(way) >= most:
            return
        order = sorted(at, key=lambda name: ((*way, name) in files, name))
        for name in order:
            last = name == order[-1]
            lines.append(bars + ("└── " if last else "├── ") + name)
            walk(at[name], (*way, name), bars + ("    " if last else "│   "))

    walk(root, (), "")
    return lines


def test_trees_of_files(spark):
    paths = ["src/b.ts", "src/a/z.ts", "src/a/k/m.ts", "README", "src/a/k/m.ts", None, "", "docs//x.md", "src/B.ts", "z/only/one.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    drawn = lambda *most: [r.line for r in render.file_tree(files, *most).orderBy("place").collect()]
    assert drawn() == plain_tree(paths) and drawn(2) == plain_tree(paths, 2) and len(drawn()) == 13
    assert render.file_tree(files.limit(0)).count() == 0


def test_answers_as_text(spark):
    nodes, edges, g = small(spark)
    queries = spark.createDataFrame([("q", "how does Ring1 turn"), ("none", "zzz")], "query_id string, query string")
    found = context.answer(g, queries, spark.createDataFrame([(f"src/f{k}.ts", TEXT) for k in range(4)], "path string, text string"), search_limit=3, max_nodes=12)
    chosen = {r.id: r for r in found.nodes.filter("query_id = 'q'").collect()}
    whole = {r.query_id: j.loads(r.text) for r in render.json(found, g.nodes).collect()}["q"]
    assert {n["id"] for n in whole["nodes"]} == set(chosen) and whole["n_nodes"] == len(chosen) and len(whole["edges"]) == found.edges.filter("query_id = 'q'").count()
    entries = [i for i, r in chosen.items() if r.role == "entry"]
    said = {r.query_id: r.text for r in render.markdown(found, queries, g.nodes).collect()}
    names = {n[0]: n[2] for n in nodes}
    assert set(said) == {"q"} and all(f"- **{names[i]}** (" in said["q"] for i in entries) and said["q"].count("```") == 2 * found.blocks.count() and "### Related symbols" in said["q"]
    drawn = {r.query_id: r.text for r in render.tree(found, g.nodes).collect()}["q"].split("\n")
    heads = [line.strip().split(": ")[1].split(" (")[0] for line in drawn if " (src/" in line]
    assert len(heads) == len(set(heads)) and {names[i] for i in entries} <= set(heads) and any("→" in line for line in drawn)
    reached = spark.createDataFrame([("c0", "m1"), ("c0", "m5"), ("c0", "m5"), ("c0", "m2")], "root string, id string")
    assert {(r.file_path, r.n, r.text) for r in render.impact(reached, g.nodes).collect()} == {("src/f1.ts", 3, "**src/f1.ts:** stop0:3, stop1:7"), ("src/f2.ts", 3, "**src/f2.ts:** ring0:4")}
    files = spark.createDataFrame([("src/f1.ts", "typescript"), ("x.py", "python"), ("src/f2.ts", "typescript")], "path string, language string")
    assert {(r.n, r.line) for r in render.files_by_language(files, g.nodes).collect()} == {(2, "- src/f1.ts (6 symbols)"), (2, "- src/f2.ts (6 symbols)"), (1, "- x.py (0 symbols)")}


def test_the_plainer_answer(spark):
    nodes, edges, g = small(spark)
    asked = {"a": "Ring1 or Oth", "b": "where is turn0 used", "c": "Other3 Other4 Other5 Other6 Other7", "d": None, "e": "  "}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    spelt = {r.query_id: set(r.s or []) for r in queries.select("query_id", question_symbols(F.col("query")).alias("s")).collect()}
    text = {}
    from symweave.operators.index import build
    from symweave.operators.search import search_fields

    left = [(q, " ".join(sorted({w for w in t.split() if w.lower() not in {s.lower() for s in spelt[q]}}))) for q, t in asked.items() if t]
    for r in search_fields(spark.createDataFrame([x for x in left if x[1]], "query_id string, query string"), build(g.nodes)).collect():
        text[r.query_id, r.id] = r.score
    expected = set()
    for q in asked:
        score = {i: s for (k, i), s in text.items() if k == q}
        score |= {i: 0.7 for i, _, name, *_ in nodes for s in spelt[q] if s[:1].isupper() and name.lower().startswith(s.lower())}
        score |= {i: 1.0 for i, _, name, *_ in nodes if name in spelt[q]}
        best = sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))[:6]
        roots = {i for i, _ in best[:3]}
        kept = {i: (s, "entry" if i in roots else "hit") for i, s in best}
        for a, b, kind in edges:
            for one, other in ((a, b), (b, a)):
                if one in roots and kind in ("calls", "references", "imports", "contains") and (one == a or kind != "contains"):
                    kept.setdefault(other, (0.0, "near"))
        by_file = {}
        for i, (s, role) in sorted(kept.items(), key=lambda kv: (-kv[1][0], kv[0])):
            by_file.setdefault(next(n[3] for n in nodes if n[0] == i), []).append((q, i, s, role))
        expected |= {x for rows in by_file.values() for x in rows[:2]}
    got = {(r.query_id, r.id, r.score, r.role) for r in context.brief(g, queries, 6, 2, 3).collect()}
    assert got == expected and {x[0] for x in got} >= {"a", "b", "c"}
