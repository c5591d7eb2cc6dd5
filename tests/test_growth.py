"""Steps that must not grow faster than what they read: what is searched, stored or compared is counted."""

import symweave.operators.context as C
import symweave.operators.graph as G
import symweave.operators.search as S
from symweave.schema import Graph


def test_affected_tests_begin_where_fewer_files_are(spark, monkeypatch):
    rows = [("a.ts", f"b{i}.ts") for i in range(30)] + [(f"b{i}.ts", "tests/x.ts") for i in range(30)] + [("tests/x.ts", "tests/y.ts"), ("c.ts", "tests/y.ts")]
    deps = spark.createDataFrame(rows, "path string, dependent string")
    changed = deps.select("path").union(deps.select("dependent")).distinct()
    begun, reach = [], G.reach
    monkeypatch.setattr(G, "reach", lambda seeds, *a, **k: begun.append(seeds.count()) or reach(seeds, *a, **k))
    expected = {(p, "tests/x.ts") for p in ["a.ts", *(f"b{i}.ts" for i in range(30))]} | {("c.ts", "tests/y.ts"), ("tests/x.ts", "tests/x.ts"), ("tests/y.ts", "tests/y.ts")}
    got = [tuple(r) for r in G.affected_tests(deps, changed).collect()]
    assert set(got) == expected and len(got) == len(expected) and begun == [2]
    few = spark.createDataFrame([("c.ts",)], "path string")
    assert [tuple(r) for r in G.affected_tests(deps, few).collect()] == [("c.ts", "tests/y.ts")] and begun == [2, 1]
    assert {tuple(r) for r in G.affected_tests(deps, changed, 1).collect()} == expected - {("a.ts", "tests/x.ts")}


def test_paths_go_on_where_fewer_nodes_are(spark, monkeypatch):
    ids = ["s", "m1", "m2", "m3", "g", *(f"x{i}" for i in range(400)), *(f"y{i}" for i in range(400))]
    edges = [("s", "m1"), ("m1", "m2"), ("m2", "m3"), ("m3", "g")] + [(f"x{i}", "m3") for i in range(400)] + [(f"y{i}", f"x{i}") for i in range(400)] + [("s", "gone")]
    graph = Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(a, b, "calls") for a, b in edges], "source string, target string, kind string"))
    rows, stored = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name, *a, **k: (lambda t: rows.append((name, t.count())) or t)(stored(df, name, *a, **k)))
    (found,) = G.paths(graph, spark.createDataFrame([("s", "g")], "start string, goal string")).collect()
    assert (found.n_steps, found.path) == (4, "s>m1>m2>m3>g")
    assert [n for name, n in rows if name == "steps"] == [804] and sum(n for name, n in rows if name == "level") <= 4


def test_definitions_meet_terms_by_whole_beginnings(spark, monkeypatch):
    def holding(*a, **k):
        raise AssertionError("names are compared with every term that shares letters")

    names = ["customer#01", "Customer#02", "xcustomer", "cust", "customer#1"]
    nodes = spark.createDataFrame([(f"n{i}", n, "class", "a.ts") for i, n in enumerate(names)], "id string, name string, kind string, file_path string")
    terms = spark.createDataFrame([("q", t) for t in ("customer#0", "cust", "zz", "")], "query_id string, term string")
    monkeypatch.setattr(S, "holding", holding)
    assert {r.id for r in C.definitions(nodes, terms, 8).collect()} == {"n0", "n1", "n3", "n4"}
    assert {(r.query, r.id, r.score) for r in S.beginning(nodes, terms.select("query_id", terms.term.alias("query"))).collect()} == {
        ("customer#0", "n0", 0.9), ("customer#0", "n1", 0.9), ("cust", "n0", 0.9), ("cust", "n1", 0.9), ("cust", "n3", 1.0), ("cust", "n4", 0.9)}


def test_index_parts_are_written_where_they_were_made(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from symweave.operators import index

    def moved(*a, **k):
        raise AssertionError("rows of the index are dealt by range")

    monkeypatch.setattr(DataFrame, "repartitionByRange", moved)
    nodes = spark.createDataFrame([("n1", "order_17", "a::order_17"), ("n2", "order_2", "a::order_2")], "id string, name string, qualified_name string")
    index.write(nodes, str(tmp_path / "index"))
    got, made = index.read(spark, str(tmp_path / "index")), index.build(nodes)
    assert all(sorted(map(str, a.collect())) == sorted(map(str, b.collect())) for a, b in zip(got, made, strict=True))


def test_ranges_without_a_file_are_a_group_of_clusters(spark):
    from symweave.operators.stats import line_clusters

    ranges = spark.createDataFrame([(None, 1, 4), (None, 5, 6), (None, 2000, 2001), ("a.ts", 1, 2)], "file_path string, start_line int, end_line int")
    assert {tuple(r) for r in line_clusters(ranges, ["file_path"], 8).collect()} == {(None, 1, 1, 6, 2), (None, 2, 2000, 2001, 1), ("a.ts", 1, 1, 2, 1)}


def test_a_level_is_dealt_into_parts_of_bounded_size(spark, monkeypatch):
    leaves, roots = [f"l{i}" for i in range(400)], [f"l{i}" for i in range(0, 400, 10)]
    graph = Graph(spark.createDataFrame([(i, "class") for i in ["hub", *leaves]], "id string, kind string"), spark.createDataFrame([("hub", i, "contains") for i in [*leaves, "gone"]], "source string, target string, kind string"))
    most, stored = [], G.stored

    def watched(df, name, *a, **k):
        if name == "level":
            most.append(max((len(p) for p in df.rdd.glom().collect()), default=0))
        return stored(df, name, *a, **k)

    monkeypatch.setattr(G, "stored", watched)
    monkeypatch.setattr(G, "PAIRS", 1000, raising=False)
    seeds = spark.createDataFrame([(i, i) for i in roots], "root string, id string")
    got = [tuple(r) for r in G.traverse(graph, seeds, "both", max_depth=3).collect()]
    expected = {(r, i, 0 if i == r else 1 if i == "hub" else 2) for r in roots for i in ["hub", *leaves]}
    assert set(got) == expected and len(got) == len(expected) and max(most) <= 4000, most


def test_texts_are_scored_in_parts_of_bounded_size(spark, monkeypatch):
    from collections import Counter
    from math import log

    texts = [(i, " ".join(["The", *(w for k, w in enumerate(("Cat", "dog-cat", "bird", "été")) if i % (k + 2) == 0)])) for i in range(300)] + [(7, "the the cat"), (7, "cat the the"), (8, ""), (9, None)]
    asked = {"q1": "the cat", "q2": "The bird? the", "q3": "nothing", "q4": "été dog"}
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(asked.items()), "query_id string, query string")
    words = lambda text: "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    rows = [(i, words(text)) for i, text in texts]
    mean, posted = sum(len(w) for _, w in rows) / len(rows), Counter((i, len(w), x) for i, w in rows for x in w)
    df, scores = Counter(x for _, _, x in posted), Counter()
    for q, query in asked.items():
        for (i, length, x), tf in posted.items():
            if x in set(words(query)):
                scores[q, i] += max(log((len(rows) - df[x] + 0.5) / (df[x] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    expected = {(q, i, round(s, 6)) for (q, i), s in scores.items() if sum((-round(t, 6), j) < (-round(s, 6), i) for (p, j), t in scores.items() if p == q) < 10}
    most, top = [], S.top
    monkeypatch.setattr(S, "top", lambda df, *a: most.append(max(len(p) for p in df.rdd.glom().collect())) or top(df, *a))
    for pairs, most_words in ((50, 1 << 13), (50, 0), (5, 1 << 13)):  # the last: more words of queries than go to every task
        monkeypatch.setattr(S, "PAIRS", pairs, raising=False)
        got = S.search_texts(docs, queries, most_words=most_words).collect()
        assert {(r.query_id, r.id, r.score) for r in got} == expected and len(got) == len(expected)
    assert max(most) <= 150, most


def test_pairs_of_a_last_level_are_not_stored(spark, monkeypatch):
    import random

    r = random.Random(5)
    ids = [f"n{i}" for i in range(120)]
    steps = {("up", "hub", i) for i in ids[:100]} | {("up", "hub2", i) for i in ids[60:]} | {("up", i, "hub") for i in ids[:50]} | {("up", i, "hub2") for i in ids[20:40]} | {("down", i, "hub") for i in ids[:30]} | {("down", "hub", i) for i in ids[50:]}
    steps |= {(w, r.choice(ids), r.choice(ids)) for w in ("up", "down") for _ in range(80)}
    barred = set(ids[::7])
    expected = {}
    for w in ("up", "down"):
        for root in ids[:50]:
            level = {root}
            for depth in range(3):
                for i in level:
                    expected.setdefault((root, i, w), depth)
                level = {b for v, a, b in steps if v == w and a in level and b not in barred}
    rows, stored = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name, *a, **k: (lambda t: rows.append((name, t.count())) or t)(stored(df, name, *a, **k)))
    monkeypatch.setattr(G, "PAIRS", 500)
    seeds = spark.createDataFrame([(i, i, w) for i in ids[:50] for w in ("up", "down")], "root string, id string, way string")
    through = spark.createDataFrame([(i,) for i in ["hub", "hub2", *ids] if i not in barred], "id string")
    found = G.reach(seeds, spark.createDataFrame([(a, b, w) for w, a, b in steps], "a string, b string, way string"), 2, through, way=["way"]).collect()
    assert {(x.root, x.id, x.way): x.depth for x in found} == expected and len(found) == len(expected)
    assert max(n for name, n in rows if name == "level") < len(expected) / 3, rows
