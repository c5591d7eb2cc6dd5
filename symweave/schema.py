"""The data model: symbols (nodes), typed relationships (edges), files and textual references."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds and languages that the data model knows.
NODE_KINDS = (
    "file", "module", "class", "struct", "interface", "trait", "protocol", "function", "method", "property", "field",
    "variable", "constant", "enum", "enum_member", "type_alias", "namespace", "parameter", "import", "export", "route", "component",
)
EDGE_KINDS = ("contains", "calls", "imports", "exports", "extends", "implements", "references", "type_of", "returns", "instantiates", "overrides", "decorates")
LANGUAGES = (
    "typescript", "javascript", "tsx", "jsx", "python", "go", "rust", "java", "c", "cpp", "csharp", "php", "ruby", "swift",
    "kotlin", "dart", "svelte", "vue", "liquid", "pascal", "scala", "lua", "luau", "unknown",
)
CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "module", "enum", "file", "namespace")
CALLER_KINDS = ("calls", "references", "imports")

NODE_SCHEMA = (
    "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, "
    "start_column int, end_column int, docstring string, signature string, visibility string, is_exported boolean, is_async boolean, "
    "is_static boolean, is_abstract boolean, decorators array<string>, type_parameters array<string>, updated_at timestamp"
)
EDGE_SCHEMA = "source string, target string, kind string, metadata struct<confidence:double,resolved_by:string>, line int, col int, provenance string"
FILE_SCHEMA = "path string, content_hash string, language string, size bigint, modified_at timestamp, indexed_at timestamp, node_count int"
REF_SCHEMA = "from_node_id string, reference_name string, reference_kind string, line int, col int, candidates array<string>, file_path string, language string"
REQUIRED = ("id", "kind", "name", "file_path", "language")


class Graph(NamedTuple):
    """Nodes and edges; nodes need id, kind, name, qualified_name, file_path, language, start_line, is_exported, and edges source, target, kind, line."""

    nodes: DataFrame
    edges: DataFrame
    index: tuple[DataFrame, ...] | None = None  # operators.index.Index of the nodes, where it is stored with them


class Dependencies(NamedTuple):
    """What files depend on: direct (path, depends_on), and through groups, where each file of users (path, group) depends on every file that the group holds (group, depends_on); rows may repeat."""

    direct: DataFrame
    users: DataFrame
    held: DataFrame


def node_id(kind: Column, file_path: Column, name: Column, line: Column) -> Column:
    """The kind and 32 hex digits of a hash over path, kind, name and line."""
    return F.concat_ws(":", kind, F.substring(F.sha2(F.concat_ws(":", file_path, kind, name, line.cast("string")), 256), 1, 32))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of the schema: missing ones null, others dropped, kinds cast."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
