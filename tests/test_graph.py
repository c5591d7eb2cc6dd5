"""Graph operators against plain Python on random graphs, and the resolution of references."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from symweave.operators import graph as G
from symweave.operators import mutate as M
from symweave.operators import resolve as R
from symweave.schema import Graph

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean"


def node(id_, kind="function", name=None, path="src/a.ts", language="typescript", line=1, exported=False, qualified=None):
    return (id_, kind, name or id_, qualified or name or id_, path, language, line, exported)


def make(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, 1) for e in edges], "source string, target string, kind string, line int"))


@pytest.fixture(scope="module")
def rand(spark):
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(30)]
    edges = [(rng.choice(ids), rng.choice([*ids, "gone"]), rng.choice(["calls", "imports", "extends", "contains", "references"])) for _ in range(70)]
    kinds = {i: rng.choice(["function", "class", "method", "file"]) for i in ids}
    return make(spark, [node(i, kinds[i]) for i in ids], edges), ids, edges, kinds


def plain_bfs(start, steps, depth=99, allowed=None):
    found, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for b in steps[at]:
            if found[at] < depth and b not in found and (allowed is None or b in allowed):
                found[b] = found[at] + 1
                queue.append(b)
    return found


def steps_of(edges, back=False, kinds=None):
    out = defaultdict(list)
    for a, b, k in edges:
        if kinds is None or k in kinds:
            out[b if back else a].append(a if back else b)
    return out


def rows(df):
    return {(r.root, r.id): r.depth for r in df.collect()}


def test_traversals_equal_plain_search(spark, rand):
    g, ids, edges, kinds = rand
    every = G.each_itself(g.nodes)
    for back, direction in ((False, "out"), (True, "in")):
        expected = {(s, b): d for s in ids for b, d in plain_bfs(s, steps_of(edges, back), 3, set(ids)).items()}
        assert rows(G.traverse(g, every, direction, max_depth=3)) == expected
    allowed = {i for i in ids if kinds[i] in ("function", "class")}
    expected = {(s, b): d for s in ids for b, d in plain_bfs(s, steps_of(edges, kinds=("calls", "extends")), allowed=allowed).items()}
    assert rows(G.traverse(g, every, "out", ("calls", "extends"), ("function", "class"))) == expected


def test_impact_descends_into_containers_for_free(spark, rand):
    g, ids, edges, kinds = rand
    containers = {i for i in ids if kinds[i] in ("class", "file")}
    down = {a: [b for x, b, k in edges if x == a and k == "contains"] for a in containers}
    back = steps_of(edges, back=True)
    expected = {}
    for s in ids:
        best = {s: 0}
        todo = deque([s])
        while todo:
            at = todo.popleft()
            for b, cost in [(b, 0) for b in down.get(at, [])] + [(b, 1) for b in back[at]]:
                if best[at] + cost <= 2 and best[at] + cost < best.get(b, 99):
                    best[b] = best[at] + cost
                    todo.append(b)
        expected |= {(s, b): d for b, d in best.items()}
    assert rows(G.impact(g, G.each_itself(g.nodes), 2)) == expected


def test_shortest_paths_are_paths_of_the_least_length(spark, rand):
    g, ids, edges, _ = rand
    pairs = spark.createDataFrame([(a, b) for a in ids[:6] for b in ids], "start string, goal string")
    got = {(r.start, r.goal): r for r in G.paths(g, pairs).collect()}
    present = {(a, b) for a, b, _ in edges}
    for a in ids[:6]:
        far = plain_bfs(a, steps_of(edges))
        for b in ids:
            assert ((a, b) in got) == (b in far)
            if b in far:
                way = got[a, b].path.split(">")
                assert len(way) - 1 == far[b] == got[a, b].n_steps and way[0] == a and way[-1] == b
                assert all((x, y) in present for x, y in zip(way, way[1:]))


def test_cycles_are_mutual_reach(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a")], "path string, depends_on string")
    got = {r.path: (r.component, r.n_files) for r in G.cycles(deps).collect()}
    assert {p: c for p, (c, _) in got.items()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_affected_tests_do_not_search_beyond_tests(spark):
    deps = spark.createDataFrame([("a.ts", "b.ts"), ("b.ts", "tests/x.ts"), ("tests/x.ts", "tests/y.ts"), ("a.ts", "c.ts")], "path string, dependent string")
    changed = spark.createDataFrame([("a.ts",), ("tests/y.ts",), ("c.ts",)], "path string")
    assert {tuple(r) for r in G.affected_tests(deps, changed).collect()} == {("a.ts", "tests/x.ts"), ("tests/y.ts", "tests/y.ts")}


def test_dead_code_and_delete(spark):
    g = make(spark, [node("f", "file"), node("a"), node("b"), node("c", exported=True), node("v", "variable")], [("f", "a", "contains"), ("f", "b", "contains"), ("a", "b", "calls")])
    assert {r.id for r in G.dead_code(g).collect()} == {"a"}
    left = M.delete_nodes(g, spark.createDataFrame([("b",)], "id string"))
    assert left.edges.count() == 1 and left.nodes.count() == 4
    merged = M.latest(spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, at int, v string"), ["key"], ["at"])
    assert [r.v for r in merged.collect()] == ["new"]


def refs(spark, *given):
    return spark.createDataFrame([(f"r{i}", *r) for i, r in enumerate(given)], "ref_id string, reference_name string, reference_kind string, file_path string, language string, line int")


def test_resolution_prefers_near_bearers(spark):
    nodes = spark.createDataFrame(
        [node("near", name="run", path="src/a/x.ts"), node("far", name="run", path="lib/z.ts"), node("py", name="run", path="src/a/y.py", language="python"), node("only", "class", "Engine", "src/e.ts", qualified="core::Engine"),
         node("start", "method", "start", "src/e.ts", qualified="core::Engine::start"), node("file", "file", "util.ts", "src/util.ts")], NODES)
    asked = refs(spark, ("run", "calls", "src/a/w.ts", "typescript", 5), ("core::Engine", "instantiates", "q.ts", "typescript", 1), ("Engine.start", "calls", "q.ts", "typescript", 1), ("util.ts", "imports", "q.ts", "typescript", 1), ("src/util.ts", "imports", "q.ts", "typescript", 1), ("ENGINE", "calls", "q.ts", "typescript", 1), ("missing", "calls", "q.ts", "typescript", 1))
    got = {r.ref_id: (r.target, r.confidence, r.resolved_by) for r in R.resolve(asked, nodes).collect()}
    assert got == {"r0": ("near", 0.7, "exact-match"), "r1": ("only", 0.95, "qualified-name"), "r2": ("start", 0.85, "qualified-name"), "r3": ("file", 0.95, "qualified-name"), "r4": ("file", 0.95, "file-path"), "r5": ("only", 0.5, "fuzzy")}
    builtins = spark.createDataFrame([("typescript", "run")], "language string, name string")
    assert "r0" not in {r.ref_id for r in R.resolve(asked, nodes, builtins).collect()}


def test_a_renamed_reexport_is_followed(spark):
    wanted = spark.createDataFrame([(1, "index", "Shown"), (2, "index", "Star"), (3, "index", "Nothing")], "import_id int, path string, name string")
    exports = spark.createDataFrame([("deep", "Hidden", "T1"), ("stars", "Star", "T2")], "path string, name string, id string")
    chain = spark.createDataFrame([("index", "Shown", "mid", "Middle"), ("mid", "Middle", "deep", "Hidden"), ("index", None, "stars", None)], "path string, name string, from_path string, original string")
    got = {r.import_id: (r.target, r.hops) for r in R.follow_reexports(wanted, chain, exports).collect()}
    assert got == {1: ("T1", 2), 2: ("T2", 1)}


def test_relative_specifiers(spark):
    df = spark.createDataFrame([("./b", "src/a"), ("../c/d", "src/a"), ("../../x", "src/a/q"), ("react", "src")], "s string, d string")
    assert [r[0] for r in df.select(R.resolve_relative(F.col("s"), F.col("d"))).collect()] == ["src/a/b", "src/c/d", "src/x", None]


def test_receivers_in_lower_case_and_by_their_words(spark):
    nodes = [
        node("c1", "class", "UserService", "src/u.ts"), node("m1", "method", "save", "src/u.ts", qualified="UserService::save"),
        node("c2", "class", "PermissionRuleEngine", "src/p.ts"), node("m2", "method", "check", "src/p.ts", qualified="PermissionRuleEngine::check"),
        node("c3", "class", "SpellEngine", "src/s.ts"), node("m3", "method", "check", "src/s.ts", qualified="SpellEngine::check"),
        node("m4", "method", "sole", "src/s.ts", qualified="Other::sole"),
    ]
    asked = ["userService.save", "UserService::save", "permissionEngine.check", "x.sole", "nobody.check"]
    refs = spark.createDataFrame([(f"r{k}", name, "calls", "src/a.ts", "typescript", 1) for k, name in enumerate(asked)], "ref_id string, reference_name string, reference_kind string, file_path string, language string, line int")
    got = {r.ref_id: (r.target, r.confidence, r.resolved_by) for r in R.by_method_call(refs, make(spark, nodes, [("c1", "m1", "contains")]).nodes).collect()}
    assert got == {"r0": ("m1", 0.8, "instance-method"), "r1": ("m1", 0.85, "qualified-name"), "r2": ("m2", 0.65, "instance-method"), "r3": ("m4", 0.7, "instance-method")}


def test_imports_answer_first(spark):
    g = make(spark, [node("f", name="run")], [("f", "f", "calls")])
    refs = spark.createDataFrame([("r", "run", "calls", "src/a.ts", "typescript", 1)], "ref_id string, reference_name string, reference_kind string, file_path string, language string, line int")
    imported = lambda left: left.select("ref_id", F.lit("other").alias("target"), F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))
    assert [tuple(r) for r in R.resolve(refs, g.nodes, imported=imported).collect()] == [("r", "other", 0.9, "import")]


def test_components_equal_mutual_reachability(spark):
    rng = random.Random(9)
    edges = sorted({(f"f{rng.randrange(24):02}", f"f{rng.randrange(24):02}") for _ in range(40)})
    deps = spark.createDataFrame(edges, "path string, depends_on string")
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    reached = {a: set(plain_bfs(a, out)) for e in edges for a in e}
    mutual = {a: {b for b in reached[a] if a in reached[b]} for a in reached}
    expected = {(a, min(own), len(own)) for a, own in mutual.items() if len(own) > 1}
    assert {tuple(r) for r in G.cycles(deps).collect()} == expected and expected
