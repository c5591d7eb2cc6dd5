"""Imports: what a file's local names stand for, and references resolved through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dir_name
from ..sources.snapshots import stored
from .extract import lines
from .lexing import uncommented
from .resolve import follow_reexports, probe_imports, resolve_relative

SCRIPTS = ("typescript", "tsx", "javascript", "jsx", "svelte", "vue")
# Endings that a specifier without one may stand for, in order.
ENDINGS = {
    "typescript": ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"],
    "python": [".py", "/__init__.py"],
}
WHOLE = "*"
#: Statements that may import.
IMPORTING = r"^\s*(?:(?:import|from|use|pub)\b|(?:\w+\s+)?\")"


def _names(list_: Column) -> Column:
    """`a, b as c` as an array of (imported, local)."""
    parts = F.filter(F.transform(F.split(list_, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^(?:type\s+)?[\w$]+"))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, F.lit(r"^type\s+"), F.lit("")))
    return F.transform(bare, lambda p: F.struct(F.regexp_extract(p, r"^([\w$]+)", 1).alias("imported"), F.regexp_extract(p, r"([\w$]+)$", 1).alias("local")))


def mappings(files: DataFrame) -> DataFrame:
    """path, language, local, imported, specifier: `*` is the whole module, `default` its default export."""
    rows = stored(lines(files).filter(F.col("text").rlike(IMPORTING)), "imports")
    script = rows.filter(F.col("language").isin(*SCRIPTS) & F.col("text").rlike(r"^\s*import\b.*\bfrom\s*['\"]")).withColumn("specifier", F.regexp_extract("text", r"from\s*['\"]([^'\"]+)['\"]", 1))
    one = lambda df, pattern, imported: df.filter(F.col("text").rlike(pattern)).select("path", "language", F.regexp_extract("text", pattern, 1).alias("local"), F.lit(imported).alias("imported"), "specifier")
    listed = lambda df, names: df.select("path", "language", F.explode(_names(names)).alias("n"), "specifier").select("path", "language", "n.local", "n.imported", "specifier")
    from_ = rows.filter(F.col("language") == "python").filter(F.col("text").rlike(r"^\s*from\s+[\w.]+\s+import\s*[^*\s]")).withColumn("specifier", F.regexp_extract("text", r"from\s+([\w.]+)\s+import", 1))
    modules = rows.filter((F.col("language") == "python") & F.col("text").rlike(r"^\s*import\s+[\w.]+"))
    plain = modules.select("path", "language", F.explode(F.split(F.regexp_extract("text", r"import\s+(.+)$", 1), r"\s*,\s*")).alias("text")).withColumn("specifier", F.regexp_extract("text", r"^([\w.]+)", 1))
    plain = plain.select("path", "language", F.coalesce(F.nullif(F.regexp_extract("text", r"\bas\s+(\w+)", 1), F.lit("")), F.split_part("specifier", F.lit("."), F.lit(1))).alias("local"), F.lit(WHOLE).alias("imported"), "specifier")
    jvm = rows.filter(F.col("language").isin("java", "kotlin", "scala") & F.col("text").rlike(r"^\s*import\s+(?:static\s+)?[\w.]+\.\w+\s*(?:as\s+\w+\s*)?;?\s*$")).withColumn("specifier", F.regexp_extract("text", r"import\s+(?:static\s+)?([\w.]+)", 1))
    last = F.regexp_extract("specifier", r"(\w+)$", 1)
    java = jvm.select("path", "language", F.coalesce(F.nullif(F.regexp_extract("text", r"\bas\s+(\w+)", 1), F.lit("")), last).alias("local"), last.alias("imported"), "specifier")
    used = rows.filter((F.col("language") == "rust") & F.col("text").rlike(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s")).withColumn("use", F.regexp_extract("text", r"\buse\s+(.+?)\s*;?\s*$", 1))
    each = F.when(F.col("use").contains("{"), F.transform(F.split(F.regexp_extract("use", r"\{([^{}]*)\}", 1), ","), lambda x: F.concat(F.regexp_extract("use", r"^([^{]*)\{", 1), F.trim(x)))).otherwise(F.array("use"))
    rust = used.select("path", "language", F.explode(each).alias("text")).filter(F.col("text").rlike(r"^[\w:]+\w(?:\s+as\s+\w+)?$")).withColumn("specifier", F.regexp_extract("text", r"^([\w:]+)", 1))
    rust = rust.select("path", "language", F.regexp_extract("text", r"(\w+)$", 1).alias("local"), last.alias("imported"), "specifier")
    go = rows.filter((F.col("language") == "go") & F.col("text").rlike(r'^\s*(?:import\s+)?(?:\w+\s+)?"[\w./-]+"\s*$')).withColumn("specifier", F.regexp_extract("text", '"([^"]+)"', 1))
    go = go.select("path", "language", F.coalesce(F.nullif(F.regexp_extract("text", r'^\s*(?:import\s+)?(\w+)\s+"', 1), F.lit("")), F.element_at(F.split("specifier", "/"), -1)).alias("local"), F.lit(WHOLE).alias("imported"), "specifier")
    php = rows.filter((F.col("language") == "php") & F.col("text").rlike(r"^\s*use\s+[\w\\]+")).withColumn("specifier", F.regexp_extract("text", r"use\s+([\w\\]+)", 1))
    php = php.select("path", "language", F.coalesce(F.nullif(F.regexp_extract("text", r"\bas\s+(\w+)", 1), F.lit("")), F.regexp_extract("specifier", r"(\w+)$", 1)).alias("local"), F.regexp_extract("specifier", r"(\w+)$", 1).alias("imported"), "specifier")
    parts = [
        one(script, r"^\s*import\s+(?!type\s*\{)([A-Za-z_$][\w$]*)\s*(?:,|from)", "default"), one(script, r"\*\s+as\s+([A-Za-z_$][\w$]*)", WHOLE), listed(script.filter(F.col("text").contains("{")), F.regexp_extract("text", r"\{([^}]*)\}", 1)),
        listed(from_, F.regexp_extract("text", r"import\s*\(?\s*(.+?)\s*\)?\s*$", 1)), plain, go, php, java, rust,
    ]
    return reduce(DataFrame.unionByName, parts)


def reexports(files: DataFrame) -> DataFrame:
    """path, name, specifier, original: `export {a as b} from` and, with a null name, `export * from`."""
    rows = stored(lines(files).filter(F.col("language").isin(*SCRIPTS) & F.col("text").rlike(r"^\s*export\b.*\bfrom\s*['\"]")).withColumn("specifier", F.regexp_extract("text", r"from\s*['\"]([^'\"]+)['\"]", 1)), "reexports")
    named = rows.filter(F.col("text").contains("{")).select("path", F.explode(_names(F.regexp_extract("text", r"\{([^}]*)\}", 1))).alias("n"), "specifier").select("path", F.col("n.local").alias("name"), "specifier", F.col("n.imported").alias("original"))
    whole = rows.filter(F.col("text").rlike(r"export\s*\*\s*from")).select("path", F.lit(None).cast("string").alias("name"), "specifier", F.lit(None).cast("string").alias("original"))
    return named.unionByName(whole)


CONFIGS = ("tsconfig.json", "jsconfig.json")
CONFIG = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"


def _joined_path(folder: Column, rest: Column) -> Column:
    """rest (`./a`, `../a` or `a`) within a folder, which may be empty."""
    whole = F.coalesce(resolve_relative(rest, folder), F.concat_ws("/", F.nullif(folder, F.lit("")), F.nullif(F.regexp_replace(rest, F.lit(r"^\.?/*$"), F.lit("")), F.lit(""))))
    return F.regexp_replace(whole, F.lit(r"^/+|/+$"), F.lit(""))


def aliases(files: DataFrame) -> DataFrame:
    """scope, prefix, wild, suffix, target, order: the paths that TypeScript and JavaScript configurations among files name for their folder, comments and commas at ends allowed.

    Without `*` a prefix is a whole specifier. baseUrl stands behind all paths, as a prefix of nothing.
    """
    configs = files.filter(F.element_at(F.split("path", "/"), -1).isin(*CONFIGS)).select("path", F.lit("json").alias("language"), "text")
    options = F.from_json(F.regexp_replace("text", F.lit(r",(\s*[}\]])"), F.lit("$1")), CONFIG)["compilerOptions"]
    own = uncommented(configs).select(dir_name(F.col("path")).alias("scope"), options.alias("o")).withColumn("base", _joined_path(F.col("scope"), F.coalesce("o.baseUrl", F.lit("."))))
    named = own.select("scope", "base", F.explode("o.paths").alias("pattern", "targets")).select("scope", "base", "pattern", F.posexplode("targets").alias("order", "to"))
    named = named.select(
        "scope", F.regexp_extract("pattern", r"^([^*]*)", 1).alias("prefix"), F.contains("pattern", F.lit("*")).alias("wild"), F.regexp_extract("pattern", r"\*(.*)$", 1).alias("suffix"), _joined_path(F.col("base"), F.col("to")).alias("target"), "order"
    )
    behind = own.filter("o.baseUrl IS NOT NULL").select("scope", F.lit("").alias("prefix"), F.lit(True).alias("wild"), F.lit("").alias("suffix"), F.concat_ws("/", F.nullif("base", F.lit("")), F.lit("*")).alias("target"), F.lit(0).alias("order"))
    return named.union(behind)


def with_aliases(specifiers: DataFrame, known: DataFrame) -> DataFrame:
    """specifiers (path, specifier) with base and order: what the alias makes of them, a row for each of its targets; nulls where none fits.

    The aliases are those of the nearest folder above that has any; an alias for the whole specifier goes first, then the longest prefix. Files meet
    folders by their ancestors, and specifiers meet prefixes by the lengths that a folder's prefixes have. known: as from aliases, or prefix and target alone.
    """
    if "scope" not in known.columns:
        known = known.select(F.lit("").alias("scope"), "prefix", F.lit(True).alias("wild"), F.lit("").alias("suffix"), F.concat("target", F.lit("*")).alias("target"), F.lit(0).alias("order"))
    parts = F.split("path", "/")
    above = specifiers.select("path").distinct().select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k - 1), "/"))).alias("depth", "scope"))
    scopes = known.groupBy("scope").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    home = above.join(scopes, "scope").groupBy("path").agg(F.max_by(F.struct("scope", "lengths"), "depth").alias("home"))
    asked = specifiers.join(home, "path").select("path", "specifier", "home.scope", F.explode("home.lengths").alias("n")).filter(F.col("n") <= F.length("specifier"))
    met = asked.withColumn("prefix", F.substr("specifier", F.lit(1), F.col("n"))).join(known, ["scope", "prefix"])
    fits = (~F.col("wild") & (F.col("prefix") == F.col("specifier"))) | (F.col("wild") & F.endswith("specifier", F.col("suffix")) & (F.length("specifier") >= F.col("n") + F.length("suffix")))
    ranked = met.filter(fits).withColumn("k", F.rank().over(Window.partitionBy("path", "specifier").orderBy("wild", F.desc("n"), F.desc(F.length("suffix"))))).filter("k = 1")
    middle = F.substr("specifier", F.col("n") + 1, F.length("specifier") - F.col("n") - F.length("suffix"))
    base = F.when(F.col("wild"), F.replace("target", F.lit("*"), middle)).otherwise(F.col("target"))
    return specifiers.join(ranked.select("path", "specifier", base.alias("base"), "order"), ["path", "specifier"], "left")


def targets(specifiers: DataFrame, files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, specifier, target: the file each specifier stands for; those of other packages are left out. specifiers: path, language, specifier."""
    own = specifiers.select("path", "language", "specifier").distinct()
    folder = dir_name(F.col("path"))
    relative = F.regexp_replace(resolve_relative(F.col("specifier"), folder), F.lit(r"^\./"), F.lit(""))
    if known is not None:
        own = own.join(with_aliases(own.select("path", "specifier").distinct(), known), ["path", "specifier"])
    else:
        own = own.withColumn("base", F.lit(None).cast("string")).withColumn("order", F.lit(0))
    module = F.when(F.col("language") == "python", F.replace("specifier", F.lit("."), F.lit("/")))
    own = own.withColumn("import_id", F.struct("path", "specifier")).withColumn("base", F.coalesce("base", relative, module)).filter("base IS NOT NULL")
    found = [
        probe_imports(own.filter(F.col("language").isin(*SCRIPTS)), files.select("path"), ENDINGS["typescript"]),
        probe_imports(own.filter("language = 'python'"), files.select("path"), ENDINGS["python"]),
    ]
    both = found[0].unionByName(found[1])
    return both.select("import_id.path", "import_id.specifier", F.col("path").alias("target"))


def by_import(refs: DataFrame, files: DataFrame, nodes: DataFrame, known_aliases: DataFrame | None = None) -> DataFrame:
    """ref_id, target, confidence 0.9, resolved_by import: references whose first part is an imported name, followed to the node that is exported under it."""
    known, passed = stored(mappings(files), "mappings"), stored(reexports(files), "reexports")
    asked = known.select("path", "language", "specifier").union(passed.join(files.select("path", "language"), "path").select("path", "language", "specifier"))
    place = stored(targets(asked, files, known_aliases), "places")
    heads = refs.select("ref_id", F.col("file_path").alias("path"), F.split_part("reference_name", F.lit("."), F.lit(1)).alias("local"), F.nullif(F.split_part("reference_name", F.lit("."), F.lit(2)), F.lit("")).alias("member"))
    hit = heads.join(known, ["path", "local"]).join(place, ["path", "specifier"])
    name = F.when(F.col("imported") == WHOLE, F.col("member")).otherwise(F.col("imported"))
    wanted = hit.select(F.col("ref_id").alias("import_id"), F.col("target").alias("path"), name.alias("name")).filter("name IS NOT NULL").distinct()
    exports = nodes.filter("is_exported").select(F.col("file_path").alias("path"), "name", "id")
    first = exports.groupBy("path").agg(F.min("id").alias("id")).select("path", F.lit("default").alias("name"), "id")
    chain = stored(passed.join(place, ["path", "specifier"]).select("path", "name", F.col("target").alias("from_path"), "original"), "chain")
    followed = follow_reexports(wanted, chain, stored(exports.unionByName(first), "exports"))
    return followed.select(F.col("import_id").alias("ref_id"), "target", F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))
