"""Scans, look-ups and filters over nodes, edges and files; point look-ups take a set of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dir_name, glob_regex
from ..schema import Graph

GLOB_KINDS = ("class", "function", "method", "interface", "type_alias", "variable", "constant")
FILTER_KINDS = ("file", "module", "class", "struct", "interface", "trait", "function", "method", "variable", "constant", "enum", "type_alias")


def by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose id is among ids (column id)."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def in_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of the files (column file_path); consumers sort by file_path, start_line, id."""
    return nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi")


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds))


def by_name(nodes: DataFrame, names: DataFrame, column: str = "name", fold: bool = False) -> DataFrame:
    """Nodes whose name (or other column) is among names (column name); fold compares lower case."""
    own, wanted = (F.lower(column), F.lower("wanted")) if fold else (F.col(column), F.col("wanted"))
    return nodes.join(names.select(F.col("name").alias("wanted")).distinct(), own == wanted, "left_semi")


def edges_of(edges: DataFrame, ids: DataFrame, direction: str = "out", kinds: Sequence[str] = (), provenance: str | None = None) -> DataFrame:
    """Edges that leave (out) or enter (in) the nodes of ids; both lists a self-loop twice."""
    if direction == "both":
        return edges_of(edges, ids, "out", kinds, provenance).unionByName(edges_of(edges, ids, "in", kinds, provenance))
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    if provenance is not None:
        edges = edges.filter(F.col("provenance") == provenance)
    end = "source" if direction == "out" else "target"
    return edges.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")


def induced(graph: Graph, ids: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """Edges with both ends among ids."""
    return edges_of(edges_of(graph.edges, ids, "out", kinds), ids, "in")


def qualified_glob(nodes: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose qualified name fits a pattern of * and ?."""
    return of_kind(nodes, *GLOB_KINDS).filter(F.col("qualified_name").rlike(glob_regex(pattern)))


def exported(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_exported")


def filtered_subgraph(graph: Graph, predicate: Column) -> Graph:
    """The nodes that satisfy a predicate, and the edges between them."""
    kept = of_kind(graph.nodes, *FILTER_KINDS).filter(predicate)
    return Graph(kept, induced(graph, kept))


def name_contains(nodes: DataFrame, part: str, but_not_at_start: bool = False) -> DataFrame:
    """Nodes with part in their name, shortest first by the column rank."""
    found = nodes.filter(F.lower("name").contains(part.lower()))
    if but_not_at_start:
        found = found.filter(~F.lower("name").startswith(part.lower()))
    return found.withColumn("rank", F.length("name"))


def module_structure(nodes: DataFrame) -> DataFrame:
    """directory, n_files, files: each folder's files in order."""
    files = nodes.select("file_path").distinct()
    return files.groupBy(dir_name(F.col("file_path")).alias("directory")).agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))


def symbol_match(nodes: DataFrame, symbol: str) -> DataFrame:
    """Nodes that a qualified symbol (a::b, a.b or a/b) names: its last part is the name, and the rest ends the qualified name or stands in the path."""
    import re

    parts = [p for p in re.split(r"::|\.|/", symbol) if p and p not in ("crate", "super", "self")]
    own = F.col("name") == parts[-1]
    if len(parts) == 1:
        return nodes.filter(own)
    tail = "::".join(parts)
    segments = F.split(F.regexp_replace("file_path", F.lit(r"\.[^./]*$"), F.lit("")), "/")
    placed = F.forall(F.array(*map(F.lit, parts[:-1])), lambda p: F.array_contains(segments, p))
    return nodes.filter(own & ((F.col("qualified_name") == tail) | F.col("qualified_name").endswith("::" + tail) | placed))


# What marks a test for the command that lists affected tests.
AFFECTED_MARKS = (r"\.spec\.", r"\.test\.", "/__tests__/", "/tests?/", "/e2e/", "/spec/")


def affected_test_path(path: Column, pattern: str | None = None) -> Column:
    """Whether a path is a test for the list of affected tests: by its marks, or by a glob of `**`, `*` and plain text found anywhere in it."""
    if pattern is None:
        return path.rlike("|".join(AFFECTED_MARKS))
    import re

    return path.rlike("".join({"**": ".+", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", pattern)))


def files_matching(files: DataFrame, folder: str = "", pattern: str = "") -> DataFrame:
    """Files (path) under a prefix, whose path holds what a glob of `**`, `*` and `?` stands for."""
    import re

    found = files.filter(F.col("path").startswith(folder) | F.col("path").startswith("./" + folder)) if folder else files
    glob = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*|\?)", pattern))
    return found.filter(F.col("path").rlike(glob)) if pattern else found
