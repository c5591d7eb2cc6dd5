"""Searches that end once they have what is asked for."""

import pytest
from pyspark.sql import functions as F

from symweave.operators import context as C
from symweave.operators import graph as G
from symweave.schema import Graph

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean"


def node(id_, kind="function"):
    return (id_, kind, id_, id_, "src/a.ts", "typescript", 1, False)


def make(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, 1) for e in edges], "source string, target string, kind string, line int"))


@pytest.fixture
def written(monkeypatch):
    """(name, rows) of each table that the graph operators and the context store."""
    found = []
    for module in (G, C):
        own = module.stored

        def noted(df, name, *args, _own=own, **more):
            kept = _own(df, name, *args, **more)
            found.append((name, kept.count()))
            return kept

        monkeypatch.setattr(module, "stored", noted)
    return found


def chain(spark, n=30):
    return make(spark, [node(f"c{i:02}", "class") for i in range(n)], [(f"c{i:02}", f"c{i - 1:02}", "extends") for i in range(1, n)])


def test_relatives_end_with_the_level_that_fills_a_query(spark, written):
    found = spark.createDataFrame([("q", "c15")], "query_id string, id string")
    assert sorted((r.id, r.round) for r in C.relatives(chain(spark), found, 16).collect()) == [("c13", 1), ("c14", 1), ("c16", 1), ("c17", 1)]
    assert max(rows for name, rows in written if name == "relatives") == 4


def test_relatives_reach_a_second_round(spark):
    g = make(spark, [node(i, "class") for i in "abcdef"], [(i, "a", "extends") for i in "bcdef"])
    found = spark.createDataFrame([("q", "b")], "query_id string, id string")
    assert sorted((r.id, r.round) for r in C.relatives(g, found, 12).collect()) == [("a", 1), ("c", 2), ("d", 2)]


def test_full_shares_are_not_searched(spark, written):
    entries = spark.createDataFrame([("q", f"c{i:02}") for i in range(20)], "query_id string, id string")
    assert {(r.root, r.id, r.depth) for r in C.expanded(chain(spark), entries, 20, 2).collect()} == {(f"c{i:02}", f"c{i:02}", 0) for i in range(20)}
    assert [rows for name, rows in written if name == "level"] == [20]


@pytest.mark.parametrize("by_id", [True, False])
def test_first_neighbours_are_enough(spark, by_id):
    hub = [("hub", f"m{i:03}", "calls" if i % 2 else "contains") for i in range(60)] + [("m003", f"a{i}", "calls") for i in range(9)] + [("m000", "a5", "extends")]
    g = make(spark, [node(i) for i in ("hub", *(f"m{i:03}" for i in range(60)), *(f"a{i}" for i in range(9)))], hub)
    seeds = spark.createDataFrame([("hub", "hub")], "root string, id string")
    every = {r.id: (r.order, r.depth, r.parent) for r in G.spanning(g, seeds, limit=1000, by_id=by_id, max_depth=2).collect()}
    few = {r.id: (r.order, r.depth, r.parent) for r in G.spanning(g, seeds, limit=6, by_id=by_id, max_depth=2).collect()}
    assert few == {i: own for i, own in every.items() if own[0] <= 6}


def test_neighbours_are_looked_for_where_entries_leave_room(spark, written):
    found = spark.createDataFrame([(q, f"c{i:02}", q == "full" or i == 9, float(i)) for q in ("full", "open") for i in range(10)], "query_id string, id string, entry boolean, score double")
    got = {(r.query_id, r.id, r.place) for r in C.filled(found, chain(spark).edges, 3).collect()}
    assert got == {("full", f"c{i:02}", 0) for i in (7, 8, 9)} | {("open", "c09", 0), ("open", "c08", 1), ("open", "c07", 2)}
    assert ("entries", 1) in written


def test_few_levels_leave_steps_where_they_are(spark, written):
    g = chain(spark)
    seeds = g.nodes.filter("id = 'c15'").select(F.col("id").alias("root"), "id")
    assert {(r.id, r.depth) for r in G.traverse(g, seeds, max_depth=1).collect()} == {("c15", 0), ("c14", 1)}
    assert not [name for name, _ in written if name == "steps"]
