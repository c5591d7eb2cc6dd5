"""Graph operators, all for many roots at once.

Traversals go level by level: a level is one join of the frontier with the edges, less what earlier levels of the same root have
reached. Each level is written to the shared folder, so plans stay short and lost executors recompute one level. Rows
carry their root, so a thousand roots cost as many levels as one, and no frontier passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_test_file
from ..schema import CALLER_KINDS, CONTAINERS, Dependencies, Graph
from ..sources.snapshots import stored
from .search import top

UNBOUNDED = 1 << 30
#: About so many pairs of a root and a node that a level finds meet in one task.
PAIRS = 1 << 20


def ways(edges: DataFrame, direction: str = "out", kinds: Sequence[str] = ()) -> DataFrame:
    """a, b, kind: edges as steps from a to b, as often as they occur."""
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "kind")
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "kind")
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def arcs(edges: DataFrame, direction: str = "out", kinds: Sequence[str] = ()) -> DataFrame:
    """a, b, kind: edges as steps from a to b, each pair and kind once."""
    return ways(edges, direction, kinds).distinct()


def reach(seeds: DataFrame, steps: DataFrame, max_depth: int = UNBOUNDED, through: DataFrame | None = None, way: Sequence[str] = (), enough: int | None = None, but: DataFrame | None = None, store: bool = True) -> DataFrame:
    """root, id, depth: every node on a path from a seed, with the least number of steps. seeds: root, id. steps: a, b; pairs may repeat.

    through: ids that may be entered; others block the way. way: further columns of seeds and steps that tell several searches in one apart.
    enough: a root is left after the level that brings it so many different nodes beside its seeds, over all ways together; those in but (root, id) don't count. So whatever is nearer than
    the enough-th node is found, and all that is as near as it.

    Of many pairs in the last level, those of each root's widest hub are made when the result is read, and moved no more (_last).

    store: whether steps are stored before they are read level by level, which they need not be if they are a stored table. Steps are not moved before
    a level needs them, unless the search is unbounded and they are sorted out once: what a few levels find is far less than all steps.
    """
    steps, allowed = steps.select(F.col("a").alias("id"), "b", *way), None if through is None else through.select("id")
    if allowed is not None and max_depth == UNBOUNDED:  # many levels: what is barred goes once
        steps, allowed = steps.join(allowed.withColumnRenamed("id", "b"), "b", "left_semi").select("id", "b", *way), None
    if store and max_depth > 1:
        steps = stored(steps, "steps")
    frontier = stored(seeds.select("root", "id", *way).distinct().withColumn("depth", F.lit(0)), "level")
    frontier = frontier.select("root", "id", *way, "depth")
    seen, depth, live = frontier, 0, frontier
    passed = frontier.select("root", "id") if but is None else frontier.select("root", "id").union(but.select("root", "id"))
    while depth < max_depth:
        depth += 1
        around = live.groupBy("id", *way).agg(F.count(F.lit(1)).alias("roots"))
        near = stored(steps.join(around, ["id", *way]).select("id", "b", *way, "roots").distinct(), "near")
        n = near.agg(F.sum("roots")).first()[0]
        if not n:
            break
        if depth == max_depth and n > PAIRS and enough is None:
            return seen.union(_last(live, near, n, way, allowed, seen, depth)).select("root", "id", "depth", *way)
        found = _pairs(live, near, n, way, allowed)
        frontier = stored(found.join(seen, ["root", "id", *way], "left_anti").withColumn("depth", F.lit(depth)).select("root", "id", *way, "depth"), "level")
        if frontier.isEmpty():
            break
        seen, live = seen.union(frontier), frontier
        if depth % 16 == 0:  # a long chain of unions in one table
            seen = stored(seen, "seen")
        if enough is not None and depth < max_depth:
            counted = seen.filter("depth > 0").select("root", "id").distinct().join(passed, ["root", "id"], "left_anti").groupBy("root").agg(F.count(F.lit(1)).alias("n"))
            live = frontier.join(stored(counted.filter(F.col("n") >= enough).select("root"), "done"), "root", "left_anti")
    return seen.select("root", "id", "depth", *way)


def _pairs(live: DataFrame, near: DataFrame, n: int, way: Sequence[str], allowed: DataFrame | None = None) -> DataFrame:
    """root, id: each node once that is a step from one of a root's nodes in live (root, id). near: id, b, and for how many roots an id is live; n: pairs before they are made distinct. allowed: ids that may be found.

    Many pairs are dealt into parts of about PAIRS: steps from a node that would alone fill more are dealt by where they lead, and met by its roots in each part; so neither a node that
    many steps leave nor their number fills a task's memory, and what is found moves once before it is made distinct.
    """
    keys, parts, every = ["id", *way], -(-n // PAIRS), near
    if allowed is not None:  # of what is near, not of all steps
        near = near.join(allowed.withColumnRenamed("id", "b"), "b", "left_semi")
    if parts > 1:
        deals = every.groupBy(*keys).agg(F.ceil(F.sum("roots") / PAIRS).alias("_deals"))
        near = near.join(deals, keys).withColumn("_deal", F.pmod(F.xxhash64("b"), F.col("_deals"))).repartition(parts, *keys, "_deal")
        live = live.join(deals, keys).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1)))
        keys = [*keys, "_deal"]
    found = live.select("root", *keys).join(near.select(*keys, "b"), keys).select("root", F.col("b").alias("id"), *way)
    return (found.repartition(parts, "root", "id", *way) if parts > 1 else found).distinct()


def _last(live: DataFrame, near: DataFrame, n: int, way: Sequence[str], allowed: DataFrame | None, seen: DataFrame, depth: int) -> DataFrame:
    """root, id, way, depth: what the last level brings that was not seen, where its pairs are many. live, near, n, allowed: as in _pairs.

    Hubs are nodes that bring many pairs. What a root finds by the widest of its hubs it finds by that once, so these pairs need not meet each other; they need only be without what the root has seen and what it
    finds by its other nodes. That is found first and goes along with the root, by parts of the hub's steps, and the rest of the pairs is made as they are read.
    """
    keys, roots = ["id", *way], ["root", *way]
    hubs = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.ceil(F.sum("roots") / PAIRS).alias("_deals"), F.sum("roots").alias("pairs")).filter(F.col("pairs") > PAIRS // 64)
    chosen = live.join(hubs, keys).groupBy(*roots).agg(F.max_by(F.struct("id", "_deals", "steps"), F.struct("steps", "id")).alias("hub"))
    chosen = stored(chosen.select(*roots, "hub.*"), "hubs")
    if allowed is not None:
        near = near.join(allowed.withColumnRenamed("id", "b"), "b", "left_semi")
    other = live.join(chosen, [*roots, "id"], "left_anti").select(*roots, "id")
    beside = stored(near.drop("roots").join(other.groupBy(*keys).agg(F.count(F.lit(1)).alias("roots")), keys), "near")
    few = beside.agg(F.sum("roots")).first()[0] or 0
    level = stored(_pairs(other, beside, few, way).join(seen, ["root", "id", *way], "left_anti").select("root", "id", *way), "level")
    wide = near.join(chosen.groupBy(*keys).agg(F.first("_deals").alias("_deals")), keys).select(*keys, "b", F.pmod(F.xxhash64("b"), F.col("_deals")).alias("_deal"))
    wide = stored(wide, "wide")
    known = seen.select("root", *way, F.col("id").alias("b")).union(level.select("root", *way, F.col("id").alias("b")))
    known = known.join(chosen, roots).join(wide, [*keys, "b"]).groupBy(*roots, "id", "_deal").agg(F.collect_set("b").alias("known"))
    dealt = chosen.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1))).select(*roots, "id", "_deal")
    dealt = stored(dealt.join(known, [*roots, "id", "_deal"], "left"), "dealt")
    made = dealt.join(wide.repartition(-(-n // PAIRS), *keys, "_deal"), [*keys, "_deal"]).filter(~F.coalesce(F.array_contains("known", F.col("b")), F.lit(False)))
    return level.withColumn("depth", F.lit(depth)).union(made.select("root", F.col("b").alias("id"), *way, F.lit(depth).alias("depth"))).select("root", "id", *way, "depth")


def each_itself(nodes: DataFrame) -> DataFrame:
    """Seeds with every node as its own root."""
    return nodes.select(F.col("id").alias("root"), "id")


def traverse(graph: Graph, seeds: DataFrame, direction: str = "out", kinds: Sequence[str] = (), node_kinds: Sequence[str] = (), max_depth: int = UNBOUNDED, include_start: bool = True) -> DataFrame:
    """root, id, depth in breadth-first order of depth. Nodes of other kinds than node_kinds block the way; a dangling end too."""
    passable = graph.nodes.filter(F.col("kind").isin(*node_kinds)) if node_kinds else graph.nodes
    starts = seeds.join(graph.nodes.select("id"), "id", "left_semi").select("root", "id")
    found = reach(starts, ways(graph.edges, direction, kinds), max_depth, passable.select("id"))
    return found if include_start else found.filter("depth > 0")


def callers(graph: Graph, seeds: DataFrame, depth: int = 1, inward: bool = True) -> DataFrame:
    """root, id, depth: who calls, references or imports the seeds (inward), or whom they do; the seeds themselves left out."""
    return traverse(graph, seeds, "in" if inward else "out", CALLER_KINDS, max_depth=depth, include_start=False)


def call_graph(graph: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """root, id, role: focal, callers and callees within depth."""
    focal = seeds.join(graph.nodes.select("id"), "id", "left_semi").select("root", "id", F.lit("focal").alias("role"))
    sides = [callers(graph, seeds, depth, inward).select("root", "id", F.lit(role).alias("role")) for inward, role in ((True, "caller"), (False, "callee"))]
    return focal.union(sides[0]).union(sides[1])


def hierarchy(graph: Graph, seeds: DataFrame, enough: int | None = None, but: DataFrame | None = None) -> DataFrame:
    """root, id, role, depth: ancestors and descendants over extends and implements, to any depth, in one search. enough, but: as in reach."""
    starts = seeds.join(graph.nodes.select("id"), "id", "left_semi").select("root", "id", F.explode(F.array(F.lit("ancestor"), F.lit("descendant"))).alias("role"))
    up, down = (ways(graph.edges, d, ("extends", "implements")).select("a", "b", F.lit(role).alias("role")) for d, role in (("out", "ancestor"), ("in", "descendant")))
    found = reach(starts, up.union(down), through=graph.nodes.select("id"), way=["role"], enough=enough, but=but)
    return found.filter("depth > 0").select("root", "id", "role", "depth")


def impact(graph: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """root, id, depth: what depends on the seeds within depth reverse steps; what a container holds counts as the container itself.

    A step back over any edge costs one; from a container down to its contents costs nothing. So each level is first
    closed over contents and then stepped back.
    """
    inside = graph.edges.filter("kind = 'contains'").join(graph.nodes.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("source")), "source", "left_semi")
    down = stored(inside.select(F.col("source").alias("a"), F.col("target").alias("b")), "contents")
    back = ways(graph.edges, "in").select("a", "b")
    level = seeds.join(graph.nodes.select("id"), "id", "left_semi").select("root", "id").distinct()
    seen = None
    for d in range(depth + 1):
        closed = reach(level, down, store=False).select("root", "id").distinct()
        fresh = closed if seen is None else closed.join(seen, ["root", "id"], "left_anti")
        fresh = stored(fresh.withColumn("depth", F.lit(d)), "impact")
        seen = fresh if seen is None else seen.union(fresh)
        if d < depth:
            level = fresh.join(back, fresh.id == back.a).select("root", F.col("b").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
    return seen


def paths(graph: Graph, pairs: DataFrame, kinds: Sequence[str] = (), max_depth: int = UNBOUNDED) -> DataFrame:
    """start, goal, n_steps, path, edge_kinds: a shortest directed path for each pair (start, goal), the least by names where there are several, and the least kind of each step.

    The search goes on a level at a time from the end whose open searches last found fewer nodes, and an end is left as soon as its pairs have met or one side leads no further, so nothing is
    closed over all it can reach. What lies between the place of meeting and the goal is walked once more, to tell the nodes on shortest paths;
    then the way back is walked from the goal over the least predecessor that is one step nearer to the start.
    """
    known = graph.nodes.select("id")
    inside = ways(graph.edges, "out", kinds).join(known.withColumnRenamed("id", "b"), "b", "left_semi").join(known.withColumnRenamed("id", "a"), "a", "left_semi")
    steps = stored(inside.groupBy("a", "b").agg(F.min("kind").alias("kind")), "steps")
    there = lambda df, end: df.join(known.withColumnRenamed("id", end), end, "left_semi")
    open_ = stored(there(there(pairs.select("start", "goal").distinct(), "start"), "goal"), "pairs")
    met = [open_.filter("start = goal").select("start", "goal", F.lit(0).alias("near"), F.lit(0).alias("far"))]
    open_ = open_.filter("start <> goal")
    sides = [stored(open_.select(F.col(end).alias("root"), F.col(end).alias("id")).distinct().withColumn("depth", F.lit(0)), "side") for end in ("start", "goal")]
    frontiers, depths, ends = list(sides), [0, 0], [("a", "b"), ("b", "a")]
    while sum(depths) < max_depth and not open_.isEmpty():
        lives = [frontiers[k].join(open_.select(F.col(end).alias("root")).distinct(), "root", "left_semi") for k, end in enumerate(("start", "goal"))]
        sizes = [live.count() for live in lives]
        k = sizes.index(min(sizes))
        end, other, (here, there_) = ("start", "goal")[k], ("start", "goal")[1 - k], ends[k]
        depths[k] += 1
        step = lives[k].join(steps.select(F.col(here).alias("id"), F.col(there_).alias("next")), "id").select("root", F.col("next").alias("id")).distinct()
        frontiers[k] = stored(step.join(sides[k], ["root", "id"], "left_anti").select("root", "id", F.lit(depths[k]).alias("depth")), "level")
        sides[k] = sides[k].union(frontiers[k])
        if depths[k] % 16 == 0:
            sides[k] = stored(sides[k], "side")
        reached = frontiers[k].withColumnRenamed("root", end).join(open_, end)
        together = reached.join(sides[1 - k].select(F.col("root").alias(other), "id"), [other, "id"]).select("start", "goal").distinct()
        met.append(stored(together.select("start", "goal", F.lit(depths[0]).alias("near"), F.lit(depths[1]).alias("far")), "met"))
        still = open_.join(met[-1], ["start", "goal"], "left_anti")
        open_ = stored(still.join(frontiers[k].select(F.col("root").alias(end)).distinct(), end, "left_semi").select("start", "goal"), "pairs")
    met_all = stored(reduce(DataFrame.union, met), "met")
    before, behind = (sides[k].withColumnRenamed("root", end) for k, end in enumerate(("start", "goal")))
    # nodes on shortest paths: up to the place of meeting by their depth from the start, from there on by what is left to the goal
    on = stored(before.join(met_all, "start").filter("depth = near").join(behind.select("goal", "id", F.col("depth").alias("rest")), ["goal", "id"]).filter("rest = far").select("start", "goal", "near", "far", "id", F.col("near").alias("place")), "on")
    beyond = on
    while not (on := on.filter("place < near + far")).isEmpty():
        further = on.join(steps.select(F.col("a").alias("id"), "b"), "id").select("start", "goal", "near", "far", F.col("b").alias("id"), (F.col("place") + 1).alias("place")).distinct()
        on = stored(further.join(behind, ["goal", "id"]).filter("depth = near + far - place").select("start", "goal", "near", "far", "id", "place"), "on")
        beyond = beyond.union(on)
    placed = before.join(met_all, "start").filter("depth < near").select("start", "goal", "id", F.col("depth").alias("place"))
    placed = stored(placed.union(beyond.select("start", "goal", "id", "place")), "placed")
    walk = stored(met_all.select("start", "goal", (F.col("near") + F.col("far")).alias("n_steps"), F.col("goal").alias("at"), (F.col("near") + F.col("far")).alias("left"), F.array("goal").alias("path"), F.array().cast("array<string>").alias("by")), "walk")
    done = walk.filter("left = 0")
    while not (walk := walk.filter("left > 0")).isEmpty():
        prior = placed.select("start", "goal", F.col("id").alias("prior"), (F.col("place") + 1).alias("left"))
        options = walk.join(prior, ["start", "goal", "left"]).join(steps.withColumnRenamed("a", "prior").withColumnRenamed("b", "at"), ["prior", "at"])
        best = options.groupBy("start", "goal", "n_steps", "left", "path", "by").agg(F.min(F.struct("prior", "kind")).alias("best"))
        walk = stored(best.select("start", "goal", "n_steps", F.col("best.prior").alias("at"), (F.col("left") - 1).alias("left"), F.concat(F.array("best.prior"), F.col("path")).alias("path"), F.concat(F.array("best.kind"), F.col("by")).alias("by")), "walk")
        done = done.unionByName(walk.filter("left = 0"))
    return done.select("start", "goal", "n_steps", F.array_join("path", ">").alias("path"), F.array_join("by", ">").alias("edge_kinds"))


def spanning(graph: Graph, seeds: DataFrame, direction: str = "out", kinds: Sequence[str] = (), node_kinds: Sequence[str] = (), max_depth: int = UNBOUNDED, limit: int = 1000, by_id: bool = False) -> DataFrame:
    """root, id, depth, order, parent, edge_kind, line, forward: the first limit nodes from each seed in the order of a queue, each with the edge that reached it.

    A node's neighbours are queued by containment first, then calls, then others; ties by the neighbour's id, kind and line. Nodes of other kinds than
    node_kinds, and dangling ends, block the way. by_id: within a level nodes are queued by their ids alone. forward: whether the edge leads from parent to node. Each level keeps, for a root, no more than its limit leaves.
    seeds may have a column limit, each root's own (limit at most); a root that has as many is not searched further. Of a node's neighbours only the first of two limits and the seeds together are looked at: each of those before one
    that is queued was a seed or queued before, and no root queues more than limit in a level or in all levels before.
    """
    rank = F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2)
    edges = graph.edges.filter(F.col("kind").isin(*kinds)) if kinds else graph.edges
    passable = graph.nodes.filter(F.col("kind").isin(*node_kinds)) if node_kinds else graph.nodes
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), rank.alias("first"), "kind", "line", F.lit(True).alias("forward"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"), rank.alias("first"), "kind", "line", F.lit(False).alias("forward"))
    steps = {"out": out, "in": back, "both": out.union(back)}[direction]
    passable, queue = passable.select("id"), [F.asc("b")] if by_id else [F.asc("way.first"), F.asc("b")]
    empty = F.lit(None).cast("string")
    own = F.least(F.col("limit"), F.lit(limit)) if "limit" in seeds.columns else F.lit(limit)
    starts = stored(seeds.join(graph.nodes.select("id"), "id", "left_semi").select("root", "id", own.cast("long").alias("limit")).distinct(), "starts")
    limits = starts.groupBy("root").agg(F.max("limit").alias("limit"))
    most_seeds = starts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    level = starts.select("root", "id").distinct().select("root", "id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("order"), empty.alias("parent"), empty.alias("edge_kind"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("boolean").alias("forward"))
    level = stored(level, "level")
    seen, depth = level, 0
    while depth < max_depth:
        depth += 1
        left = seen.groupBy("root").agg(F.max("order").alias("so_far")).join(limits, "root").filter("so_far < limit").select("root")
        live = stored(level.join(left, "root", "left_semi").select("root", F.col("id").alias("a"), "order"), "live")
        if live.isEmpty():
            break
        around = steps.join(stored(live.select("a").distinct(), "around"), "a").groupBy("a", "b").agg(F.min(F.struct("first", "kind", "line", "forward")).alias("way"))
        ways = top(around.join(passable.withColumnRenamed("id", "b"), "b", "left_semi"), ["a"], queue, most_seeds + 2 * limit).drop("rank")
        offers = live.join(ways, "a").groupBy("root", F.col("b").alias("id")).agg(F.min(F.struct("order", "way.first", "way.kind", "way.line", "a", "way.forward")).alias("by"))
        fresh = offers.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        queued = top(fresh, ["root"], [F.asc("id")] if by_id else [F.asc("by.order"), F.asc("by.first"), F.asc("id")], limit)
        sizes = seen.groupBy("root").agg(F.max("order").alias("so_far"))
        placed = queued.join(sizes, "root").join(limits, "root").withColumn("order", F.col("so_far") + F.col("rank")).filter(F.col("order") <= F.col("limit"))
        level = stored(placed.select("root", "id", F.lit(depth).alias("depth"), "order", F.col("by.a").alias("parent"), F.col("by.kind").alias("edge_kind"), F.col("by.line").alias("line"), F.col("by.forward").alias("forward")), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def pre_order(tree: DataFrame) -> DataFrame:
    """tree (root, id, depth, order, parent) with first: each node's place, from 1, where a node's children follow it in their order, each with all below it.

    Sizes of subtrees are summed up level by level from the deepest, and places handed down again.
    """
    tree = stored(tree, "tree")
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return tree.withColumn("first", F.lit(None).cast("long"))
    sizes = []
    for d in range(deepest, -1, -1):
        own = tree.filter(F.col("depth") == d)
        if sizes:
            below = sizes[-1].groupBy("root", F.col("parent").alias("id")).agg(F.sum("size").alias("below"))
            own = own.join(below, ["root", "id"], "left").withColumn("size", 1 + F.coalesce("below", F.lit(0))).drop("below")
        else:
            own = own.withColumn("size", F.lit(1).cast("long"))
        sizes.append(stored(own, "sizes"))
    earlier = Window.partitionBy("root", "parent").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    found = [stored(sizes.pop().withColumn("first", F.lit(1).cast("long")), "first")]
    while sizes:
        own = sizes.pop().withColumn("_shift", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        above = found[-1].select("root", F.col("id").alias("parent"), F.col("first").alias("_above"))
        found.append(stored(own.join(above, ["root", "parent"]).withColumn("first", F.col("_above") + 1 + F.col("_shift")).select(*tree.columns, "size", "first"), "first"))
    return reduce(DataFrame.unionByName, found).drop("size")


def parents(graph: Graph) -> DataFrame:
    """id, parent: the container of each node; the least by id if there are several."""
    held = graph.edges.filter("kind = 'contains'").join(graph.nodes.select(F.col("id").alias("source")), "source", "left_semi")
    return held.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))


def ancestors(graph: Graph, seeds: DataFrame) -> DataFrame:
    """root, id, depth: the containers of each seed up to the outermost."""
    up = parents(graph).select(F.col("id").alias("a"), F.col("parent").alias("b"))
    return reach(seeds, up).filter("depth > 0")


def children(graph: Graph) -> DataFrame:
    """parent, and the columns of the node it contains."""
    return graph.edges.filter("kind = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("id")).join(graph.nodes, "id")


def usages(graph: Graph) -> DataFrame:
    """target, edge_kind, and the columns of the node that uses it, for each edge of any kind."""
    return graph.edges.select("target", F.col("kind").alias("edge_kind"), F.col("source").alias("id")).join(graph.nodes, "id")


def metrics(graph: Graph) -> DataFrame:
    """id, in_degree, out_degree, call_count, caller_count, child_count, depth of every node; the edges are read once for each end.

    depth is the number of ancestors, counted from the outermost nodes down, each node once; only nodes that contain each other are followed up one by one.
    """
    edges = graph.edges
    out = edges.groupBy(F.col("source").alias("id")).agg(
        F.count(F.lit(1)).alias("out_degree"), F.count_if(F.col("kind") == "calls").alias("call_count"), F.count_if(F.col("kind") == "contains").alias("child_count")
    )
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"), F.count_if(F.col("kind") == "calls").alias("caller_count"))
    held = stored(parents(graph), "parents")
    outer = graph.nodes.join(held.select("id"), "id", "left_anti").select(F.lit("outermost").alias("root"), "id")
    deep = reach(outer, held.select(F.col("parent").alias("a"), F.col("id").alias("b")), store=False).select("id", F.col("depth").cast("long").alias("depth"))
    circular = held.join(deep.select("id"), "id", "left_anti").select(F.col("id").alias("root"), "id")
    circular = reach(circular, held.select(F.col("id").alias("a"), F.col("parent").alias("b"))).filter("depth > 0").groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("depth"))
    deep = deep.union(circular)
    joined = graph.nodes.select("id").join(out, "id", "left").join(into, "id", "left").join(deep, "id", "left")
    return joined.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree", "call_count", "caller_count", "child_count", "depth")))


def dead_code(graph: Graph) -> DataFrame:
    """Functions, methods and classes that are not exported and that nothing but their container points at."""
    used = graph.edges.filter("kind <> 'contains'").select(F.col("target").alias("id"))
    own = graph.nodes.filter(F.col("kind").isin("function", "method", "class") & ~F.coalesce("is_exported", F.lit(False)))
    return own.join(used, "id", "left_anti")


def node_context(graph: Graph, seeds: DataFrame) -> DataFrame:
    """root, role, id: focal node, ancestors, children, incoming and outgoing neighbours, types, and imports of the node's file."""
    starts = seeds.join(graph.nodes.select("id"), "id", "left_semi").select("root", "id")
    out = starts.join(graph.edges, starts.id == graph.edges.source).select("root", "kind", F.col("target").alias("id"))
    into = starts.join(graph.edges, starts.id == graph.edges.target).select("root", "kind", F.col("source").alias("id"))
    above = ancestors(graph, starts)
    homes = above.unionByName(starts.withColumn("depth", F.lit(0))).join(graph.nodes.filter("kind = 'file'").select("id"), "id", "left_semi")
    role = lambda df, name: df.select("root", F.lit(name).alias("role"), "id")
    found = (
        role(starts, "focal").union(role(above, "ancestor")).union(role(out.filter("kind = 'contains'"), "child")).union(role(out.filter("kind <> 'contains'"), "outgoing"))
        .union(role(into.filter("kind <> 'contains'"), "incoming")).union(role(out.filter("kind IN ('type_of', 'returns')"), "type"))
        .union(role(homes.join(graph.edges.filter("kind = 'imports'"), homes.id == graph.edges.source).select("root", F.col("target").alias("id")), "import"))
    )
    return found.distinct().join(graph.nodes.select("id"), "id", "left_semi").select("root", "role", "id")


def file_dependencies(graph: Graph) -> DataFrame:
    """path, depends_on: the files that each file imports."""
    files = graph.nodes.filter("kind = 'file'").select("id", F.col("file_path").alias("path"))
    other = graph.nodes.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on"))
    found = files.join(graph.edges.filter("kind = 'imports'"), files.id == graph.edges.source).join(other, "target")
    return found.filter("path <> depends_on").select("path", "depends_on").distinct()


def file_dependents(graph: Graph) -> DataFrame:
    """path, dependent: the files that import a file or something it exports."""
    own = graph.nodes.filter("kind = 'file' OR is_exported").select(F.col("id").alias("target"), F.col("file_path").alias("path"))
    other = graph.nodes.select(F.col("id").alias("source"), F.col("file_path").alias("dependent"))
    found = graph.edges.filter("kind = 'imports'").join(own, "target").join(other, "source")
    return found.filter("path <> dependent").select("path", "dependent").distinct()


def cycles(dependencies: DataFrame | Dependencies) -> DataFrame:
    """path, component, n_files: files on a cycle of imports, with their strongly connected component (named by its least path).

    All simple cycles can be exponentially many; membership says the same. Files that nothing leads to, or that lead nowhere, are taken off
    until none is left. Then each file takes the least name that reaches it; the files that also reach the file of that name are its
    component. The rest goes round again. No file is closed over all others. A group of dependencies is passed like a file, but has no name and does not count.
    """
    direct, no_name = (dependencies, F.lit(None)) if isinstance(dependencies, DataFrame) else (dependencies.direct, F.lit("\0"))
    steps, is_group = direct.select(F.col("path").alias("a"), F.col("depends_on").alias("b")).filter("a <> b"), lambda c: F.coalesce(F.startswith(F.col(c), no_name), F.lit(False))
    if direct is not dependencies:  # no path begins with the mark of groups
        own = F.concat(no_name, "group")
        steps = steps.union(dependencies.users.select("path", own)).union(dependencies.held.select(own, "depends_on"))
    edges, found = stored(steps.distinct(), "edges"), []
    while True:
        n = -1
        while n != (n := edges.count()):
            edges = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            edges = stored(edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "edges")
        if not n:
            break
        least = stored(edges.select(F.col("a").alias("id")).distinct().withColumn("least", F.when(~is_group("id"), F.col("id"))), "least")
        while True:
            offers = edges.join(least.select(F.col("id").alias("a"), F.col("least").alias("offer")), "a").groupBy(F.col("b").alias("id")).agg(F.min("offer").alias("offer"))
            after = stored(least.join(offers, "id").select("id", F.least("least", "offer").alias("least"), F.coalesce(F.col("offer") < F.col("least"), F.col("offer").isNotNull()).alias("moved")), "least")
            least = after.select("id", "least")
            if after.filter("moved").isEmpty():
                break
        own = lambda end: least.select(F.col("id").alias(end), F.col("least").alias(f"of_{end}"))
        within = edges.join(own("a"), "a").join(own("b"), "b").filter("of_a = of_b")
        seeds = least.filter("id = least").select(F.col("id").alias("root"), "id")
        members = stored(reach(seeds, within.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("root", "id"), "members")
        found.append(members.filter(~is_group("id")))
        gone = members.select("id")
        edges = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        edges = stored(edges, "edges")
    if not found:
        return direct.sparkSession.createDataFrame([], "path string, component string, n_files long")
    members = reduce(DataFrame.union, found)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n_files")).filter("n_files > 1")
    return members.join(sizes, "root").select(F.col("id").alias("path"), F.col("root").alias("component"), "n_files")


def reach_through(roots: DataFrame, goals: DataFrame, steps: DataFrame, into: DataFrame, out: DataFrame, depth: int) -> DataFrame:
    """root, id: each node of goals (id) once that is within depth steps of a root (id) and not itself. steps: a, b. into (a, group) and out (group, b): from each a of a group to each b of it is one step, too.

    Neither the steps through groups nor what a root finds there are told one by one before the result: it is found once what a group leads to over steps alone, from which group to which others, and
    once for all roots that come to the same groups after equally many steps; what they find is handed to each of them last, and moves no more.
    """
    steps = stored(steps.select("a", "b").distinct(), "steps")
    into, out = stored(into.select(F.col("a").alias("id"), "group").distinct(), "into"), stored(out.select("group", "b").distinct(), "out")
    near = stored(reach(roots.select(F.col("id").alias("root"), "id"), steps, depth, store=False), "near")
    inner = reach(out.select(F.col("group").alias("root"), F.col("b").alias("id")), steps, depth - 1, store=False).select(F.col("root").alias("group"), "id", (F.col("depth") + 1).alias("depth"))
    inner = stored(inner, "inner")
    entered = stored(near.filter(F.col("depth") < depth).join(into, "id").groupBy("root", "group").agg(F.min("depth").alias("cost")), "entered")
    hops = stored(inner.filter(F.col("depth") < depth).withColumnRenamed("group", "by").join(into, "id").groupBy("by", "group").agg(F.min("depth").alias("more")), "hops")
    ways = entered.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("group", "cost"))).alias("ways"))
    alike = stored(ways.join(ways.groupBy("ways").agg(F.min("root").alias("like")), "ways").select("root", "like"), "alike")
    costs = entered.join(alike.filter("root = like"), "root").select("like", "group", "cost")
    fresh = costs = stored(costs, "costs")
    while not fresh.isEmpty():  # a step or more from group to group, so depth times at most
        offers = fresh.withColumnRenamed("group", "by").join(hops, "by").select("like", "group", (F.col("cost") + F.col("more")).alias("offer")).filter(F.col("offer") < depth)
        offers = offers.groupBy("like", "group").agg(F.min("offer").alias("offer")).join(costs, ["like", "group"], "left").filter("cost IS NULL OR offer < cost")
        fresh = stored(offers.select("like", "group", F.col("offer").alias("cost")), "costs")
        costs = costs.union(fresh).groupBy("like", "group").agg(F.min("cost").alias("cost"))
    shared = stored(costs.join(inner, "group").filter(F.col("cost") + F.col("depth") <= depth).select("like", "id").distinct().join(goals, "id", "left_semi").select("like", "id"), "shared")
    own = near.filter("depth > 0").select("root", "id").join(goals, "id", "left_semi").join(alike, "root", "left").join(shared, ["like", "id"], "left_anti").select("root", "id")
    return own.union(alike.join(shared, "like").filter("root <> id").select("root", "id"))


def affected_through(dependencies: Dependencies, changed: DataFrame, depth: int = 5) -> DataFrame:
    """As affected_tests, of files that depend on others through groups, too. The search begins at the tests."""
    test = lambda c: is_test_file(F.col(c))
    steps = dependencies.direct.filter(~test("depends_on")).select(F.col("path").alias("a"), F.col("depends_on").alias("b"))
    into, out = dependencies.users.select(F.col("path").alias("a"), "group"), dependencies.held.filter(~test("depends_on")).select("group", F.col("depends_on").alias("b"))
    asked = stored(changed.select("path").distinct(), "changed")
    tests = steps.select("a").union(into.select("a")).filter(test("a")).distinct().select(F.col("a").alias("id"))
    found = reach_through(tests, asked.select(F.col("path").alias("id")), steps, into, out, depth).select(F.col("id").alias("changed"), F.col("root").alias("test"))
    return found.union(asked.filter(test("path")).select(F.col("path").alias("changed"), F.col("path").alias("test")))


def affected_tests(dependents: DataFrame, changed: DataFrame, depth: int = 5) -> DataFrame:
    """changed, test: test files within depth steps back over dependents of each changed file (column path). A test is not searched beyond; a changed test is its own.

    The search begins where fewer files are: at the changed files, or at the tests, from which all that is entered is no test, so that each node a search finds is a row of the result.
    """
    test = is_test_file(F.col("path"))
    steps = stored(dependents.filter(~test).select(F.col("path").alias("a"), F.col("dependent").alias("b")).distinct(), "steps")
    asked = stored(changed.select("path").distinct(), "changed")
    tests, open_ = steps.filter(is_test_file(F.col("b"))).select("b").distinct(), asked.filter(~test)
    if tests.count() < open_.count():
        back = reach(tests.select(F.col("b").alias("root"), F.col("b").alias("id")), steps.select(F.col("b").alias("a"), F.col("a").alias("b")), depth, store=False).filter("depth > 0")
        found = back.select(F.col("id").alias("changed"), F.col("root").alias("test")).join(open_.withColumnRenamed("path", "changed"), "changed", "left_semi")
    else:
        found = reach(open_.select(F.col("path").alias("root"), F.col("path").alias("id")), steps, depth, store=False).filter(is_test_file(F.col("id")))
        found = found.select(F.col("root").alias("changed"), F.col("id").alias("test"))
    return found.union(asked.filter(test).select(F.col("path").alias("changed"), F.col("path").alias("test")))
