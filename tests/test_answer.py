"""Context from a question to a sentence, on a small graph, against plain Python."""

from collections import defaultdict

from pyspark.sql import functions as F

from symweave.operators import context
from symweave.schema import Graph

TEXT = "\n".join(f"line {k} of a file" for k in range(1, 60))


def small(spark):
    nodes = [(f"c{k}", "class", f"Ring{k}" if k < 3 else f"Other{k}", f"src/f{k % 4}.ts", 1 + 5 * k, 4 + 5 * k) for k in range(9)]
    nodes += [(f"m{k}", "method", ("turn", "stop", "ring", "go")[k % 4] + str(k // 4), f"src/f{k % 4}.ts", 2 + k, 3 + k) for k in range(16)]
    edges = [(f"c{k % 9}", f"m{k}", "contains") for k in range(16)] + [(f"m{k}", f"m{(k * 5 + 3) % 16}", "calls") for k in range(16)] + [("c0", "c1", "extends"), ("c1", "c4", "extends"), ("c8", "c0", "implements"), ("m1", "c5", "references")]
    frame = spark.createDataFrame(nodes, "id string, kind string, name string, file_path string, start_line int, end_line int")
    frame = frame.selectExpr("*", "concat(name, '') AS qualified_name", "'typescript' AS language", "true AS is_exported")
    return nodes, edges, Graph(frame, spark.createDataFrame(edges, "source string, target string, kind string").withColumn("line", F.lit(1)))


def test_expansion_shares_and_is_nearest_first(spark):
    nodes, edges, g = small(spark)
    ways = defaultdict(set)
    for a, b, _ in edges:
        ways[a].add(b)
        ways[b].add(a)
    entries = [("q", "c0"), ("q", "m5"), ("p", "c3")]
    got = {(r.query_id, r.root, r.id): r.depth for r in context.expanded(g, spark.createDataFrame(entries, "query_id string, id string"), 9, 3).collect()}
    expected = {}
    for q, root in entries:
        level, now, depth = {root: 0}, {root}, 0
        while depth < 3:
            depth += 1
            now = {b for a in now for b in ways[a]} - set(level)
            level |= dict.fromkeys(now, depth)
        share = -(-9 // sum(e[0] == q for e in entries))
        expected |= {(q, root, i): d for i, d in sorted(level.items(), key=lambda kv: (kv[1], kv[0]))[:share]}
    assert got == expected


def test_an_answer_holds_together(spark):
    nodes, edges, g = small(spark)
    files = spark.createDataFrame([(f"src/f{k}.ts", TEXT) for k in range(4)], "path string, text string")
    found = context.answer(g, spark.createDataFrame([("q", "how does the ring turn"), ("p", "Ring1"), ("z", "nothing here")], "query_id string, query string"), files, search_limit=4, max_nodes=12)
    chosen = defaultdict(dict)
    for r in found.nodes.collect():
        chosen[r.query_id][r.id] = r
    assert "c1" in {i for i, r in chosen["p"].items() if r.role == "entry"} and "z" not in chosen and all(len(own) <= 12 for own in chosen.values())
    got = {(r.query_id, r.source, r.target, r.kind) for r in found.edges.collect()}
    assert got == {(q, a, b, k) for q, own in chosen.items() for a, b, k in edges if k in context.RECOVERED and a in own and b in own} and got
    place = {n[0]: n for n in nodes}
    for r in found.blocks.collect():
        assert r.code == "\n".join(TEXT.split("\n")[place[r.id][4] - 1 : place[r.id][5]]) and chosen[r.query_id][r.id].role == "entry"
    for r in found.summary.collect():
        own = chosen[r.query_id]
        best = [place[i][2] for i, v in sorted(own.items(), key=lambda kv: (-kv[1].score, kv[0])) if v.role == "entry"]
        more = f" and {len(best) - 3} more" if len(best) > 3 else ""
        n_edges = sum(q == r.query_id for q, *_ in got)
        assert r.summary == f"{len(own)} symbols of {len({place[i][3] for i in own})} files with {n_edges} edges among them. Begin with: {', '.join(best[:3])}{more}."
