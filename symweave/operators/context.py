"""Assembling context: merging search channels, trimming to budgets, and slicing source text."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import dir_name, is_test_file, path_relevance, question_symbols, stems, title_case, words_of
from ..schema import Graph
from ..sources.snapshots import stored
from .index import Index, build
from .graph import children, hierarchy, spanning
from .lookup import induced, of_kind
from .search import DEALT, beginning, compound, holding, rescored, search_fields, term_hits, top

# Kinds that define a type, and kinds whose hierarchy is followed.
TYPE_KINDS = ("class", "interface", "struct", "trait", "protocol", "enum", "type_alias")
HIERARCHY_KINDS = ("class", "interface", "struct", "trait", "protocol")
# What a definition that begins with a term gains, and at most for being short; what names of several terms gain or lose.
PREFIX_POINTS, BREVITY_MOST, BREVITY_STEP = 15.0, 10, 3
THREE_GROUPS, TWO_GROUPS, ONE_GROUP = 2.5, 2.0, 0.6
RECOVERED = ("calls", "extends", "implements", "references", "overrides")
DAMPED = 0.3
# For projects of fewer files than the first figure, how many explorations are advised, and a report's most characters, files,
# characters a file, lines between clusters, symbols in a file's header and edges of a kind.
BUDGETS = (
    (500, 1, 18000, 5, 3800, 8, 6, 6),
    (5000, 2, 13000, 6, 2500, 10, 8, 8),
    (15000, 3, 35000, 12, 7000, 15, 15, 15),
    (25000, 4, 38000, 14, 7000, 15, 15, 15),
    (None, 5, 38000, 14, 7000, 15, 15, 15),
)
BUDGET_NAMES = ("calls", "most_chars", "most_files", "file_chars", "gap", "header_symbols", "edges_per_kind")
#: From so many files on, a report names further files and says what it leaves out.
NOTES_FROM = 500


def merged(*channels: DataFrame) -> DataFrame:
    """query_id, id, score: the best score of each hit over all channels."""
    return reduce(DataFrame.unionByName, (c.select("query_id", "id", "score") for c in channels)).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def damp_tests(hits: DataFrame) -> DataFrame:
    """hits with a file_path: those in test files count for less."""
    return hits.withColumn("score", F.when(is_test_file(F.col("file_path")), F.col("score") * DAMPED).otherwise(F.col("score")))


def definitions(nodes: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """query_id, id, score: for each term (query_id, term) the best types whose name begins with it: the search score, PREFIX_POINTS and more for short names.

    Terms that are written in title case already are left to exact names.
    """
    asked = terms.filter(F.col("term") != title_case(F.col("term"))).select("query_id", F.lower("term").alias("query")).distinct()
    hits = rescored(beginning(of_kind(nodes, *TYPE_KINDS), asked))
    brevity = F.greatest(F.lit(0), BREVITY_MOST - F.floor((F.length("name") - F.length("query")) / BREVITY_STEP))
    scored = hits.withColumn("score", F.col("total") + PREFIX_POINTS + brevity)
    best = top(scored, ["query_id", "query"], [F.desc("score"), F.asc("id")], most)
    return best.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def inside_names(nodes: DataFrame, terms: DataFrame, most: int, index: Index | None = None) -> DataFrame:
    """query_id, id, score: types whose name has a term (query_id, query, term) in title case behind another letter, as blueRing and HTTPRing have ring.

    8 and more for short names and for the path; with n terms a score s becomes s (1 + n) + 30 (n - 1). Of each term 2 most take part, and most remain.
    Tests are left out unless they are asked for.
    """
    title = title_case(F.col("term"))
    asked = terms.select("query_id", "query", F.lower("term").alias("term")).distinct().filter(F.length("term") >= 3).withColumn("title", title)
    own = of_kind(nodes, *TYPE_KINDS).select("id", "name", "file_path")
    hits = holding(own.select("name"), "name", asked, "title", index and index.runs).join(own, "name")
    place = F.instr(F.col("name"), F.col("title"))
    hits = hits.filter((place > 1) & F.substr("name", place - 1, F.lit(1)).rlike("[a-zA-Z]") & (F.lower("query").rlike("test|spec") | ~is_test_file(F.col("file_path"))))
    points = 8 + F.greatest(F.lit(0.0), 6 - (F.length("name") - F.length("title")) / 4) + path_relevance(F.col("file_path"), words_of(F.col("query")), F.col("query"))
    few = top(hits.withColumn("score", points.cast("double")), ["query_id", "term"], [F.desc("score"), F.asc("id")], 2 * most)
    merged_ = few.groupBy("query_id", "id").agg(F.max("score").alias("s"), F.count(F.lit(1)).alias("n"))
    return top(merged_.select("query_id", "id", (F.col("s") * (1 + F.col("n")) + 30 * (F.col("n") - 1)).alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], most).drop("rank")


def term_groups(terms: DataFrame) -> DataFrame:
    """query_id, groups: arrays of terms (query_id, term) that say the same: each with the longest term that holds it (ties by name)."""
    all_ = terms.groupBy("query_id").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("terms"))
    heads = F.filter("terms", lambda t: ~F.exists("terms", lambda u: (u != t) & F.contains(u, t)))
    by_length = F.transform(F.array_sort(F.transform(heads, lambda h: F.struct((-F.length(h)).alias("n"), h.alias("h")))), lambda x: x["h"])
    headed = all_.withColumn("heads", by_length)
    first = lambda t: F.get(F.filter("heads", lambda h: F.contains(h, t)), F.lit(0))
    return headed.select("query_id", F.transform("heads", lambda h: F.filter("terms", lambda t: first(t) == h)).alias("groups"))


def weigh_groups(hits: DataFrame, terms: DataFrame, exact: DataFrame) -> DataFrame:
    """hits (query_id, id, name, file_path, score) weighed by how many groups of a query's terms their name or a folder of theirs holds, for queries of two terms or more.

    exact: query_id, id of hits that are not weighed down.
    """
    groups = term_groups(terms).filter(F.size(F.flatten("groups")) >= 2)
    folders = F.split(F.lower(dir_name(F.col("file_path"))), "/")
    held = F.size(F.filter("groups", lambda g: F.exists(g, lambda t: F.contains(F.lower("name"), t) | F.array_contains(folders, t))))
    marked = hits.join(groups, "query_id", "left").join(exact.select("query_id", "id").distinct().withColumn("exact", F.lit(True)), ["query_id", "id"], "left")
    factor = F.when(F.col("groups").isNull(), 1.0).when(held >= 3, THREE_GROUPS).when(held == 2, TWO_GROUPS).when(F.col("exact"), 1.0).otherwise(ONE_GROUP)
    return marked.withColumn("score", F.col("score") * factor).drop("groups", "exact")


def to_definitions(hits: DataFrame, graph: Graph) -> DataFrame:
    """query_id, id, score: imports and exports among hits (query_id, id, score) give way to what they stand for, with their score; those that stand for nothing go."""
    kinds = hits.join(graph.nodes.select("id", "kind"), "id")
    as_is = kinds.filter("kind NOT IN ('import', 'export')").select("query_id", "id", "score")
    edges = graph.edges.filter("kind IN ('imports', 'exports')").select(F.col("source").alias("id"), F.col("target"), F.rtrim("kind", F.lit("s")).alias("kind"))
    stood_for = kinds.join(edges, ["id", "kind"]).select("query_id", F.col("target").alias("id"), "score").join(graph.nodes.select("id"), "id", "left_semi").select("query_id", "id", "score")
    return as_is.union(stood_for).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def relatives(graph: Graph, found: DataFrame, most_nodes: int) -> DataFrame:
    """query_id, id, round: types of the hierarchy of those among found (query_id, id), and in a second round of what the first found, a quarter of most_nodes at most.

    Both rounds go level by level and leave a query with the level that brings it as many as it may keep; the second is for queries that the first has not filled.
    """
    most = -(-most_nodes // 4)
    types = of_kind(graph.nodes, *HIERARCHY_KINDS).select("id")
    known = stored(found.select("query_id", "id").distinct(), "known")
    rooted = lambda df: df.select(F.col("query_id").alias("root"), "id")
    of_query = lambda df: df.select(F.col("root").alias("query_id"), "id", "depth").groupBy("query_id", "id").agg(F.min("depth").alias("depth"))
    first = of_query(hierarchy(graph, rooted(known.join(types, "id", "left_semi")), most, rooted(known)))
    first = stored(first.join(known, ["query_id", "id"], "left_anti"), "relatives")
    full = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select("query_id")
    open_ = first.join(full, "query_id", "left_anti")
    gone = stored(known.union(first.select("query_id", "id")), "gone")
    second = of_query(hierarchy(graph, rooted(open_.join(types, "id", "left_semi")), most, rooted(gone))).join(gone, ["query_id", "id"], "left_anti")
    both = first.withColumn("round", F.lit(1)).union(second.withColumn("round", F.lit(2)))
    return top(both, ["query_id"], [F.asc("round"), F.asc("depth"), F.asc("id")], most).select("query_id", "id", "round")


def filled(found: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """query_id, id, place: entries of found (query_id, id, entry, score) first, then neighbours of entries, then the rest, most for each query.

    Neighbours are looked for only where entries leave room for them.
    """
    room = found.groupBy("query_id").agg(F.count_if("entry").alias("n")).filter(F.col("n") < most).select("query_id")
    entries = stored(found.filter("entry").select("query_id", "id").join(room, "query_id", "left_semi"), "entries")
    around = [edges.select(F.col(a).alias("id"), F.col(b).alias("other")).join(entries, "id") for a, b in (("source", "target"), ("target", "source"))]
    near = around[0].union(around[1]).select("query_id", F.col("other").alias("id")).distinct().withColumn("near", F.lit(1))
    placed = found.join(near, ["query_id", "id"], "left").withColumn("place", F.when(F.col("entry"), 0).otherwise(2 - F.coalesce("near", F.lit(0))))
    return top(placed, ["query_id"], [F.asc("place"), F.desc("score"), F.asc("id")], most).select("query_id", "id", "place")


def per_file_cap(hits: DataFrame, keys: list[str], most_nodes: int) -> DataFrame:
    """At most max(5, a fifth of most_nodes) hits of each file (columns keys, file_path, score, id)."""
    return top(hits, [*keys, "file_path"], [F.desc("score"), F.asc("id")], max(5, -(-most_nodes // 5))).drop("rank")


def other_code_cap(hits: DataFrame, keys: list[str], most_nodes: int) -> DataFrame:
    """At most max(3, 15 % of most_nodes) hits of each query in tests, samples and the like."""
    ranked = hits.withColumn("is_test", is_test_file(F.col("file_path")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "is_test").orderBy(F.desc("score"), "id")))
    return ranked.filter(~F.col("is_test") | (F.col("rank") <= max(3, -(-15 * most_nodes // 100)))).drop("rank", "is_test")


def recovered_edges(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges of the meaningful kinds between the chosen nodes, each once."""
    return induced(graph, ids, RECOVERED).select("source", "target", "kind").distinct()


def file_groups(hits: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """file_path, score, n: files by what they hold of the hits (id, file_path, entry): 10 for an entry, 3 for a neighbour of one, else 1."""
    entries = hits.filter("entry").select("id")
    near = edges.join(entries, edges.source == entries.id, "left_semi").select(F.col("target").alias("id")).union(edges.join(entries, edges.target == entries.id, "left_semi").select(F.col("source").alias("id"))).distinct()
    marked = hits.join(near.withColumn("near", F.lit(True)), "id", "left")
    points = F.when(F.col("entry"), 10).when(F.col("near"), 3).otherwise(1)
    return marked.groupBy("file_path").agg(F.sum(points).alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("score") >= least)


def code_blocks(nodes: DataFrame, files: DataFrame, most_chars: int = 1500) -> DataFrame:
    """id, file_path, start_line, end_line, code: the lines of each node (with an end_line) out of its file (path, text), cut at most_chars."""
    lines = files.select(F.col("path").alias("file_path"), F.split("text", "\n").alias("lines"))
    joined = nodes.join(lines, "file_path")
    code = F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))), "\n")
    cut = F.when(F.length("code") > most_chars, F.concat(F.substr("code", F.lit(1), F.lit(most_chars)), F.lit("\n// ... cut"))).otherwise(F.col("code"))
    return joined.withColumn("code", code).select("id", "file_path", "start_line", "end_line", cut.alias("code"))


def packed(blocks: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Blocks (score, chars, id), best first (ties by id), each taken if it fits in what the budget leaves; the first always. Blocks without chars are all taken.

    Once a block does not fit, none of its size does, so of each size only the best budget / size can be taken: some budget * ln(budget) blocks of a group
    at most, which are found by ranks within parts of each size first; then one pass over those few chooses.
    """
    order = [F.desc("score"), F.asc("id")]
    sized = blocks.select(*keys, "id", "score", F.greatest(F.coalesce("chars", F.lit(0)), F.lit(0)).cast("long").alias("chars"))
    first = sized.groupBy(*keys).agg(F.min_by(F.struct("id", "score", "chars"), F.struct(-F.col("score"), "id")).alias("b")).select(*keys, "b.*")
    fitting = sized.filter((F.col("chars") > 0) & (F.col("chars") <= budget)).withColumn("_part", F.monotonically_increasing_id() % DEALT)
    for by in ([*keys, "chars", "_part"], [*keys, "chars"]):
        fitting = fitting.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") * F.col("chars") <= budget)
    few = fitting.select(*keys, "id", "score", "chars").union(first).distinct()
    schema = StructType([*few.select(*keys, "id").schema.fields])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        used, taken = 0, []
        for chars in group["chars"].tolist():
            fits = not taken or used + chars <= budget
            used += chars if fits else 0
            taken.append(fits)
        return group.loc[taken, [*keys, "id"]]

    chosen = few.groupBy(*keys).applyInPandas(choose, schema).union(sized.filter("chars = 0").select(*keys, "id")).distinct()
    return blocks.join(chosen, [*keys, "id"], "left_semi").select(*blocks.columns)


def headers(members: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, header, left_out: a group's most frequent symbols (members: symbol, start_line; ties by where they come first, then by name), and how many more there are."""
    counts = members.groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("line"))
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("symbols"))
    best = top(counts, keys, [F.desc("n"), F.asc("line"), F.asc("symbol")], most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("best"))
    left = F.greatest(F.col("symbols") - most, F.lit(0))
    listed = F.concat(F.array_join("best.symbol", ", "), F.when(left > 0, F.concat(F.lit(", +"), left.cast("string"), F.lit(" more"))).otherwise(""))
    return best.join(sizes, keys).select(*keys, listed.alias("header"), left.alias("left_out"))


def within_total(sections: DataFrame, keys: list[str], budget: int, most: int, beside: int = 200, least: int = 500) -> DataFrame:
    """keys, id, rank, shown: of a group's first most sections (id, place, chars) those that the budget holds, each with beside characters around it.

    The first that does not fit is shown in part, if least characters or more are left, and ends the group.
    """
    few = top(sections, keys, [F.asc("place"), F.asc("id")], most)
    upto = Window.partitionBy(*keys).orderBy("rank")
    size = F.col("chars") + beside
    placed = few.withColumn("_before", F.coalesce(F.sum(size).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_over", F.col("_before") + size > budget)
    placed = placed.withColumn("_done", F.coalesce(F.max("_over").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    left = budget - F.col("_before") - beside
    shown = F.when(~F.col("_over"), F.col("chars")).when(left >= least, left)
    return placed.filter(~F.col("_done")).withColumn("shown", shown.cast("long")).filter("shown IS NOT NULL").select(*keys, "id", "rank", "shown")


def outline(graph: Graph) -> DataFrame:
    """parent, n, text: the members of each container by line, imports and exports left out."""
    members = children(graph).filter("kind NOT IN ('import', 'export')")
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit("):"), F.col("start_line").cast("string"))
    own = members.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", line.alias("line")))).alias("rows"))
    return own.select("parent", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def explore_budget(projects: DataFrame, count: str = "n_files") -> DataFrame:
    """projects with the budgets that their number of files allows."""
    n = F.col(count)
    tier = lambda k: F.coalesce(*(F.when(n < b[0], F.lit(b[k])) if b[0] else F.lit(b[k]) for b in BUDGETS))
    return projects.select("*", *(tier(k).alias(name) for k, name in enumerate(BUDGET_NAMES, 1)), (n >= NOTES_FROM).alias("with_notes"))


def expanded(graph: Graph, entries: DataFrame, most: int, depth: int) -> DataFrame:
    """query_id, root, id, depth: what each entry (query_id, id) reaches both ways, nearest first (ties by id); the entries of a query share most nodes evenly, and no search keeps more than the largest share of its root."""
    roots = entries.select("query_id", F.col("id").alias("root")).distinct()
    share = roots.groupBy("query_id").agg(F.ceil(most / F.count(F.lit(1))).alias("share"))
    limits = roots.join(share, "query_id").groupBy("root").agg(F.max("share").alias("limit"))
    tree = spanning(graph, limits.select("root", F.col("root").alias("id"), "limit"), "both", max_depth=depth, limit=most, by_id=True)
    return tree.join(roots, "root").join(share, "query_id").filter(F.col("order") <= F.col("share")).select("query_id", "root", "id", "depth")


def summary(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, n_nodes, n_edges, n_files, summary: what was chosen (query_id, id, name, file_path, score, entry) in a sentence with the three best entries."""
    ends = chosen.select("query_id", "id")
    inner = edges.join(ends.withColumnRenamed("id", "source"), "source").join(ends.withColumnRenamed("id", "target"), ["query_id", "target"])
    n_edges = inner.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges"))
    sizes = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file_path").alias("n_files"), F.count_if("entry").alias("n_entries"))
    first = top(chosen.filter("entry"), ["query_id"], [F.desc("score"), F.asc("id")], 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("best"))
    all_ = sizes.join(n_edges, "query_id", "left").join(first, "query_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    names = F.coalesce(F.array_join("best.name", ", "), F.lit(""))
    more = F.when(F.col("n_entries") > 3, F.concat(F.lit(" and "), (F.col("n_entries") - 3).cast("string"), F.lit(" more"))).otherwise("")
    said = F.format_string("%d symbols of %d files with %d edges among them. Begin with: %s%s.", "n_nodes", "n_files", "n_edges", names, more)
    return all_.select("query_id", "n_nodes", "n_edges", "n_files", said.alias("summary"))


def markdown(nodes: DataFrame, title: str = "Symbols") -> DataFrame:
    """file_path, text: for each file a section that lists its nodes by line."""
    line = F.concat(F.lit("- `"), "name", F.lit("` ("), "kind", F.lit(", line "), F.col("start_line").cast("string"), F.lit(")"))
    rows = nodes.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", line.alias("line")))).alias("rows"))
    return rows.select("file_path", F.concat(F.lit(f"## {title} in "), "file_path", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


def relevant(graph: Graph, queries: DataFrame, search_limit: int = 8, max_nodes: int = 80, depth: int = 3, min_score: float = 0.3) -> DataFrame:
    """query_id, id, score, role: for each query (query_id, query) the entry symbols that search channels agree on, and their surroundings in the graph.

    Channels are exact names, those that the question spells out included, with a boost for files that hold several, types that begin with a term, ranked text search by single terms, names of several
    terms and types with terms inside their names; the best score of each node counts, weighed by how many of the query's terms it has, less for tests.
    Imports give way to what they stand for. Entries are expanded both ways, sharing max_nodes, and by their hierarchies; entries and their neighbours go first, and a
    file's share and that of tests are capped.
    """
    nodes = graph.nodes
    terms = stored(queries.select("query_id", "query", F.explode(words_of(F.col("query"))).alias("term")), "terms")
    with_stems = stored(terms.select("query_id", F.explode(F.array_append(stems(F.col("term")), F.col("term"))).alias("term")).distinct(), "stems")
    named = queries.select("query_id", F.explode(question_symbols(F.col("query"))).alias("term")).select("query_id", F.lower("term").alias("term"))
    exact_hits = with_stems.union(named).distinct().join(nodes.select("id", F.lower("name").alias("term"), "file_path"), "term")
    together = exact_hits.groupBy("query_id", "file_path").agg(F.countDistinct("term").alias("n"))
    exact = stored(exact_hits.join(together, ["query_id", "file_path"]).select("query_id", "id", (100.0 + 20 * (F.col("n") - 1)).alias("score")), "exact")
    single = with_stems.select(F.concat_ws("\u0001", "query_id", "term").alias("query_id"), F.col("term").alias("query"))
    index = graph.index or build(nodes)
    ranked = search_fields(single, index)
    text = term_hits(ranked.select(F.split_part("query_id", F.lit("\u0001"), F.lit(1)).alias("query_id"), F.split_part("query_id", F.lit("\u0001"), F.lit(2)).alias("term"), "id", "score"))
    channels = [exact, definitions(nodes, with_stems, search_limit), text, compound(nodes, terms, index), inside_names(nodes, terms, search_limit, index)]
    found = to_definitions(merged(*channels), graph).join(nodes.select("id", "name", "file_path"), "id")
    weighed = damp_tests(weigh_groups(found, terms, exact))
    entries = stored(top(weighed.filter(F.col("score") >= min_score), ["query_id"], [F.desc("score"), F.asc("id")], search_limit).select("query_id", "id", "score"), "entries")
    near = expanded(graph, entries, max_nodes, depth).groupBy("query_id", "id").agg(F.min("depth").alias("depth"))
    kin = relatives(graph, entries, max_nodes).select("query_id", "id", F.col("round").alias("depth"))
    around = near.union(kin).groupBy("query_id", "id").agg(F.min("depth").alias("depth"))
    placed = around.join(entries.withColumnRenamed("score", "own"), ["query_id", "id"], "left").join(nodes.select("id", "file_path"), "id")
    scored = placed.select("query_id", "id", "file_path", F.coalesce("own", 1.0 / (1 + F.col("depth"))).alias("score"), F.col("own").isNotNull().alias("entry"))
    kept = stored(other_code_cap(per_file_cap(scored, ["query_id"], max_nodes), ["query_id"], max_nodes), "around")
    chosen = filled(kept, graph.edges, max_nodes).join(kept, ["query_id", "id"])
    return chosen.select("query_id", "id", F.round("score", 6).alias("score"), F.when(F.col("entry"), "entry").otherwise("near").alias("role"))


def brief(graph: Graph, queries: DataFrame, most: int = 20, per_file: int = 10, roots: int = 10) -> DataFrame:
    """query_id, id, score, role: a plainer answer. Names that a query (query_id, query) spells score 1, names that begin with a capitalised one of them 0.7, and what else it says is
    searched for as text; the best are expanded by one step to callers, callees and members. The best `most` of each query are entries or hits, expansion adds to these, and no file keeps more than per_file.

    A node counts once, by its first channel. Ties go to the least id. Queries without words and null queries have no rows.
    """
    nodes = graph.nodes
    words = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split("query", r"\s+"), lambda w: w != ""))).alias("word"))
    spelt = queries.select("query_id", F.explode(question_symbols(F.col("query"))).alias("name"))
    same = spelt.join(nodes.select("id", "name"), "name").select("query_id", "id", F.lit(1.0).alias("score"), F.lit(0).alias("channel"))
    index = graph.index or build(nodes)
    capital = spelt.filter(F.col("name").rlike(r"^\p{Lu}")).select("query_id", F.lower("name").alias("begin"))
    runs = capital.withColumn("gram", F.substr("begin", F.lit(1), F.lit(3))).join(index.runs.withColumnRenamed("name", "bearer"), "gram").filter(F.lower("bearer").startswith(F.col("begin"))).select("query_id", F.col("bearer").alias("name")).distinct()
    longer = runs.join(nodes.select("id", "name"), "name").select("query_id", "id", F.lit(0.7).alias("score"), F.lit(1).alias("channel"))
    said = words.withColumn("low", F.lower("word")).join(spelt.select("query_id", F.lower("name").alias("low")), ["query_id", "low"], "left_anti")
    text = search_fields(said.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("query")), index).select("query_id", "id", "score", F.lit(2).alias("channel"))
    hits = same.unionByName(longer).unionByName(text).groupBy("query_id", "id").agg(F.min_by("score", F.struct("channel", -F.col("score"))).alias("score"))
    best = stored(top(hits, ["query_id"], [F.desc("score"), F.asc("id")], most).select("query_id", "id", "score", "rank"), "brief")
    own = best.select("query_id", "id", "score", F.when(F.col("rank") <= roots, "entry").otherwise("hit").alias("role"))
    near = graph.edges.filter(F.col("kind").isin("calls", "references", "imports", "contains")).select("source", "target", "kind")
    starts = best.filter(F.col("rank") <= roots).select("query_id", F.col("id").alias("root"))
    ways = starts.join(near, F.col("root") == F.col("source")).select("query_id", F.col("target").alias("id")).union(starts.join(near.filter("kind <> 'contains'"), F.col("root") == F.col("target")).select("query_id", F.col("source").alias("id")))
    more = ways.distinct().join(own.select("query_id", "id"), ["query_id", "id"], "left_anti").join(nodes.select("id"), "id", "left_semi").select("query_id", "id", F.lit(0.0).alias("score"), F.lit("near").alias("role"))
    placed = own.unionByName(more).join(nodes.select("id", "file_path"), "id")
    return top(placed, ["query_id", "file_path"], [F.desc("score"), F.asc("id")], per_file).select("query_id", "id", "score", "role")


class Answer(NamedTuple):
    """nodes: query_id, id, score, role. edges: query_id, source, target, kind. blocks: query_id, id, file_path, start_line, end_line, code. summary: query_id, n_nodes, n_edges, n_files, summary."""

    nodes: DataFrame
    edges: DataFrame
    blocks: DataFrame | None
    summary: DataFrame


def answer(graph: Graph, queries: DataFrame, files: DataFrame | None = None, most_blocks: int = 5, most_chars: int = 1500, **limits) -> Answer:
    """What relevant finds for each query, the edges that the chosen nodes have among each other, the code of its best entries (if files are given: path, text; nodes need an end_line), and a sentence."""
    chosen = stored(relevant(graph, queries, **limits), "chosen")
    ends = chosen.select("query_id", "id")
    meant = graph.edges.filter(F.col("kind").isin(*RECOVERED)).select("source", "target", "kind")
    edges = meant.join(ends.withColumnRenamed("id", "source"), "source").join(ends.withColumnRenamed("id", "target"), ["query_id", "target"]).select("query_id", "source", "target", "kind").distinct()
    best = top(chosen.filter("role = 'entry'"), ["query_id"], [F.desc("score"), F.asc("id")], most_blocks).select("query_id", "id")
    blocks = None if files is None else best.join(code_blocks(graph.nodes.join(best.select("id").distinct(), "id", "left_semi"), files, most_chars), "id")
    named = chosen.join(graph.nodes.select("id", "name", "file_path"), "id").withColumn("entry", F.col("role") == "entry")
    return Answer(chosen, edges, blocks, summary(named, edges.select("source", "target", "kind").distinct()))
