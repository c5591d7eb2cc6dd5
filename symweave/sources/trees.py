"""Source trees as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import path_glob_regex
from ..operators.extract import language_of
from .snapshots import stored

MOST_BYTES = 1 << 20
EXCLUDED = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/target/**", "**/vendor/**", "**/__pycache__/**", "**/*.min.js")


def wanted(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Exclusion wins; then any inclusion admits; without any, a path is not wanted."""
    fits = lambda globs: reduce(Column.__or__, (path.rlike(path_glob_regex(g)) for g in globs), F.lit(False))
    return ~fits(exclude) & fits(include)


def _folders(path: Column, itself: bool = False) -> Column:
    """The folders that hold a path, from the outermost, which is the empty name, on; with the path itself at the end if it is to be."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) + (1 if itself else 0)), lambda k: F.array_join(F.slice(parts, F.lit(1), k - 1), "/"))


def ignore_rules(rules: DataFrame) -> DataFrame:
    """folder, n, regex, negated, folders_only for each line of rules (folder, text) that says something.

    `#` begins a comment, `!` admits again, a `/` at the end speaks of folders, one elsewhere ties the pattern to its folder; `*` and `?` stay within a name, `**` does not.
    """
    rows = rules.select("folder", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("line", F.rtrim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("negated", F.col("line").startswith("!")).withColumn("line", F.regexp_replace("line", F.lit("^(!|\\\\(?=[!#]))"), F.lit("")))
    rows = rows.withColumn("folders_only", F.col("line").endswith("/")).withColumn("line", F.regexp_replace("line", F.lit("/+$"), F.lit(""))).filter("line <> ''")
    tied, bare = F.col("line").contains("/"), F.regexp_replace("line", F.lit("^/+"), F.lit(""))
    for pattern, by in ((r"([.+^$(){}|])", r"\\$1"), (r"\[!", "[^"), (r"^\*\*/", "\u0001"), (r"/\*\*/", "/\u0001"), (r"/\*\*$", "\u0002"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", "/.*")):
        bare = F.regexp_replace(bare, F.lit(pattern), F.lit(by))
    return rows.select("folder", "n", F.concat(F.when(tied, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), bare, F.lit("$")).alias("regex"), "negated", "folders_only")


def not_ignored(paths: DataFrame, rules: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """paths (path and more) without what rules (folder, text) ignore: of the rules that fit a name, the last of the innermost folder decides, and nothing below an ignored folder comes back.

    repositories: folders that are repositories of their own; rules from outside end there. Names meet rules by the folders around them, and files meet ignored names by their own.
    """
    asked = stored(ignore_rules(rules), "rules")
    entries = paths.select("path", F.posexplode(_folders(F.col("path"), True)).alias("k", "entry")).filter("entry <> ''").select("entry", (F.col("entry") != F.col("path")).alias("is_folder")).distinct()
    around = entries.select("entry", "is_folder", F.posexplode(_folders(F.col("entry"))).alias("depth", "folder"))
    if repositories is not None:
        inner = around.join(repositories.select("folder").distinct().withColumn("own", F.lit(True)), "folder", "left")
        deepest = Window.partitionBy("entry", "is_folder")
        around = inner.withColumn("from_depth", F.coalesce(F.max(F.when(F.col("own"), F.col("depth"))).over(deepest), F.lit(0))).filter(F.col("depth") >= F.col("from_depth")).drop("own", "from_depth")
    met = around.join(asked, "folder").filter(F.col("is_folder") | ~F.col("folders_only"))
    relative = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substr("entry", F.length("folder") + 2))
    verdict = met.withColumn("relative", relative).filter(F.expr("relative RLIKE regex")).groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct("depth", "n")).alias("negated"))
    gone = verdict.filter("NOT negated").select("entry", "is_folder")
    below = paths.select("path", F.explode(_folders(F.col("path"), True)).alias("entry")).withColumn("is_folder", F.col("entry") != F.col("path"))
    return paths.join(below.join(gone, ["entry", "is_folder"], "left_semi").select("path").distinct(), "path", "left_anti").select(*paths.columns)


def read_tree(
    spark: SparkSession, root: str, include: Sequence[str] = ("**/*",), exclude: Sequence[str] = EXCLUDED, ignore_marker: str = "symweave.ignore", most_bytes: int = MOST_BYTES, rules_name: str = "symweave.rules", repository_marker: str = "symweave.repository"
) -> tuple[DataFrame, DataFrame]:
    """Files (path, language, size, modified_at, content_hash, text) and errors (path, code). Folders that hold the marker file are left out (it must not be hidden or empty: Spark reads neither); files over most_bytes are errors.

    Files called rules_name say what is ignored in their folder and below; folders that hold a repository_marker are repositories of their own (see not_ignored).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file://").rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", F.lit("^file:/+"), F.lit("/")), F.lit(f"^{base}/"), F.lit(""))
    listed = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    named = lambda name: F.element_at(F.split("path", "/"), -1) == name
    folder = F.regexp_replace("path", F.lit("/?[^/]*$"), F.lit("")).alias("folder")
    marked = listed.filter(named(ignore_marker)).select(folder)
    rules, repositories = listed.filter(named(rules_name)).select(folder, F.col("content").cast("string").alias("text")), listed.filter(named(repository_marker)).select(folder)
    ours = listed.select("path").filter(wanted(F.col("path"), include, exclude) & ~F.element_at(F.split("path", "/"), -1).isin(ignore_marker, rules_name, repository_marker))
    held = ours.select("path", F.explode(_folders(F.col("path"))).alias("folder")).join(marked.distinct(), "folder", "left_semi").select("path").distinct()
    names = not_ignored(ours.join(held, "path", "left_anti"), rules, repositories)
    kept = listed.join(names, "path", "left_semi")
    errors = kept.filter(F.col("size") > most_bytes).select("path", F.lit("size_exceeded").alias("code"))
    fit = kept.filter(F.col("size") <= most_bytes).withColumn("text", F.col("content").cast("string"))
    files = fit.select("path", language_of(F.col("path"), F.col("text")).alias("language"), "size", "modified_at", F.sha2("content", 256).alias("content_hash"), "text")
    return files, errors
