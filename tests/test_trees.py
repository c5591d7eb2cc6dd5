"""Spanning trees, their pre-order and paths against a queue, on small drawn graphs."""

import random
from collections import defaultdict

import pytest

from symweave.operators import graph as G
from symweave.schema import Graph

KINDS = ("contains", "calls", "references", "imports")


def drawn(spark, seed):
    draw = random.Random(seed)
    nodes = [(f"n{k:02}", draw.choice(["class", "function", "method"])) for k in range(24)]
    edges = sorted({(draw.choice(nodes)[0], draw.choice(nodes)[0], draw.choice(KINDS), draw.randrange(9)) for _ in range(70)} | {("n01", "gone", "calls", 1)})
    return nodes, edges, Graph(spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame(edges, "source string, target string, kind string, line int"))


def queued(nodes, edges, root, direction, node_kinds, max_depth, limit):
    kind, rank = dict(nodes), {"contains": 0, "calls": 1}
    ways = defaultdict(dict)
    for a, b, k, line in edges:
        for x, y, forward in ((a, b, True), (b, a, False)):
            if direction == "both" or forward == (direction == "out"):
                way = rank.get(k, 2), k, line, forward
                ways[x][y] = min(ways[x].get(y, way), way)
    found, queue = {root: (0, 1, None, None, None)}, [root]
    while queue:
        at = queue.pop(0)
        depth, order = found[at][:2]
        if depth == max_depth:
            continue
        for b in sorted(ways[at], key=lambda b: (ways[at][b][0], b)):
            if b in found or b not in kind or (node_kinds and kind[b] not in node_kinds) or len(found) == limit:
                continue
            found[b] = depth + 1, len(found) + 1, at, ways[at][b][1], ways[at][b][2]
            queue.append(b)
    return found


@pytest.mark.parametrize("seed, direction, node_kinds, depth, limit", [(1, "out", (), 9, 1000), (2, "both", (), 3, 11), (3, "in", ("class", "function"), 4, 1000), (4, "both", (), 9, 5)])
def test_trees_equal_a_queue(spark, seed, direction, node_kinds, depth, limit):
    nodes, edges, g = drawn(spark, seed)
    roots = ["n00", "n07", "n13", "missing"]
    tree = G.spanning(g, spark.createDataFrame([(r, r) for r in roots], "root string, id string"), direction, node_kinds=node_kinds, max_depth=depth, limit=limit)
    got = {r: {} for r in roots}
    for r in G.pre_order(tree).collect():
        got[r.root][r.id] = r
    for root in roots[:-1]:
        expected = queued(nodes, edges, root, direction, node_kinds, depth, limit)
        assert {i: (r.depth, r.order, r.parent, r.edge_kind, r.line) for i, r in got[root].items()} == expected
        below = defaultdict(list)
        for i, v in sorted(expected.items(), key=lambda kv: kv[1][1]):
            below[v[2]].append(i)
        order, stack = [], [root]
        while stack:
            at = stack.pop()
            order.append(at)
            stack += reversed(below[at])
        assert sorted(got[root], key=lambda i: got[root][i].first) == order
    assert not got["missing"]


def test_paths_equal_a_search_from_the_start(spark):
    nodes, edges, g = drawn(spark, 5)
    pairs = [(f"n{a:02}", f"n{b:02}") for a in range(0, 24, 3) for b in range(24)] + [("n01", "gone"), ("nowhere", "n01")]
    kinds = {}
    after = defaultdict(set)
    for a, b, k, _ in edges:
        if b != "gone":
            after[a].add(b)
            kinds[a, b] = min(k, kinds.get((a, b), k))
    expected = {}
    for start, goal in pairs:
        level, depth = {start: 0} if start in dict(nodes) else {}, 0
        now = list(level)
        while now:
            depth += 1
            now = sorted({b for a in now for b in after[a]} - set(level))
            level |= dict.fromkeys(now, depth)
        if goal in level:
            path = [goal]
            while path[0] != start:
                path.insert(0, min(a for a, d in level.items() if d == level[path[0]] - 1 and path[0] in after[a]))
            expected[start, goal] = (level[goal], ">".join(path), ">".join(kinds[p] for p in zip(path, path[1:])))
    found = G.paths(g, spark.createDataFrame(pairs, "start string, goal string")).collect()
    assert {(r.start, r.goal): (r.n_steps, r.path, r.edge_kinds) for r in found} == expected and len(found) == len(expected)
    assert {(r.start, r.goal) for r in G.paths(g, spark.createDataFrame(pairs, "start string, goal string"), max_depth=2).collect()} == {p for p, v in expected.items() if v[0] <= 2}
