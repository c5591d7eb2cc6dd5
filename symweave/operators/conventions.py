"""What frameworks say about names: which frameworks a project uses, and which symbol a name stands for by their habits.

Conventions are rows of rules, to which a project may add its own. A name is answered once for each rule, from what bears it, so that frequent names
meet their bearers in an aggregation, not reference by reference.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT = ("typescript", "javascript", "tsx", "jsx")


class Mark(NamedTuple):
    """A framework is used where a file's path matches and, if given, its text does too."""

    framework: str
    path: str
    text: str | None = None


class Convention(NamedTuple):
    """Names that match stand for nodes of these kinds named `key` (the name if empty; `$1::$2` names a container, too), best in places that match.

    Elsewhere the confidence is `otherwise`, and there is no answer if that is 0.
    """

    framework: str
    languages: tuple[str, ...]
    name: str
    kinds: tuple[str, ...]
    place: str = ""
    confidence: float = 0.8
    otherwise: float = 0.0
    key: str = ""


# Files by which frameworks are known, and the names, kinds, folders and confidences of their habits.
MARKS = [
    Mark("laravel", r"^artisan$"), Mark("laravel", r"^app/Http/Kernel\.php$"),
    Mark("express", r"^package\.json$", r'"(?:express|fastify|koa|hapi)"\s*:'), Mark("express", r"routes|controllers|middleware", r"express|app\.get|router\.get"),
    Mark("nest", r"^package\.json$", r'"@nestjs/'), Mark("nest", r"\.(?:controller\.[tj]s|module\.ts|resolver\.ts|gateway\.ts)$", r"@nestjs/|@Controller|@Module\(|@Resolver\(|@WebSocketGateway\("),
    Mark("react", r"^package\.json$", r'"(?:react|next|react-native)"\s*:'), Mark("react", r"\.[jt]sx$"),
    Mark("django", r"^(?:requirements\.txt|setup\.py|pyproject\.toml)$", r"(?i)django"), Mark("django", r"^manage\.py$"),
    Mark("rails", r"^Gemfile$", r"'rails'"), Mark("rails", r"^(?:config/application|app/controllers/application_controller|config/routes)\.rb$"),
    Mark("spring", r"^(?:pom\.xml|build\.gradle(?:\.kts)?)$", r"spring"), Mark("spring", r"\.java$", r"@SpringBootApplication|@RestController|@Service|@Repository"),
    Mark("go", r"^go\.mod$"), Mark("go", r"\.go$"), Mark("rust", r"^Cargo\.toml$"),
    Mark("aspnet", r"\.csproj$", r"Microsoft\.AspNetCore"), Mark("aspnet", r"^(?:Program|Startup)\.cs$"), Mark("aspnet", r"/Controllers/.*Controller\.cs$"),
]
CONVENTIONS = [
    Convention("laravel", ("php",), r"^([A-Z][a-zA-Z]+)::(\w+)$", ("method",), r"^app/(?:Models/)?\w+\.php$", 0.85, 0.0, "$1::$2"), Convention("laravel", ("php",), r"^([A-Z][a-zA-Z]+)::(\w+)$", ("class",), r"^app/(?:Models/)?\w+\.php$", 0.85, 0.0, "$1"),
    Convention("laravel", ("php",), r"^([A-Z][a-zA-Z]+Controller)@(\w+)$", ("method",), r"^app/Http/Controllers/", 0.9, 0.9, "$1::$2"),
    *(Convention("nest", SCRIPT, rf"{end}$", ("class",), rf"\.{end.lower()}\.", 0.85, 0.7) for end in ("Service", "Controller", "Resolver", "Gateway", "Repository", "Guard", "Interceptor", "Pipe", "Module")),
    Convention("django", ("python",), r"Model$|^[A-Z][a-z]+$", ("class",), r"models", 0.8, 0.8), Convention("django", ("python",), r"View(?:Set)?$", ("class", "function"), r"views", 0.8, 0.8), Convention("django", ("python",), r"Form$", ("class",), r"forms", 0.8, 0.8),
    Convention("rails", ("ruby",), r"^[A-Z][a-zA-Z]+$", ("class",), r"app/models/", 0.8), Convention("rails", ("ruby",), r"Controller$", ("class",), r"controllers/", 0.85),
    Convention("rails", ("ruby",), r"Helper$", ("module",), r"^app/helpers/", 0.8), Convention("rails", ("ruby",), r"(?:Service|Job)$", ("class",), r"^app/(?:services|jobs)/", 0.8),
    Convention("spring", ("java", "kotlin"), r"Service$", ("class", "interface"), r"/services?/", 0.85, 0.85), Convention("spring", ("java", "kotlin"), r"Repository$", ("class", "interface"), r"/repositor(?:y|ies)/", 0.85, 0.85),
    Convention("spring", ("java", "kotlin"), r"Controller$", ("class",), r"/controllers?/", 0.85, 0.85), Convention("spring", ("java", "kotlin"), r"^[A-Z][a-zA-Z]+$", ("class",), r"/(?:entity|entities|models?|domain)/", 0.7, 0.7),
    Convention("spring", ("java", "kotlin"), r"(?:Component|Config)$", ("class",), r"/(?:components?|config)/", 0.8, 0.8),
    Convention("go", ("go",), r"Handler$|^Handle", ("function",), r"/?(?:handlers?|api|routes|controllers?)/", 0.8, 0.8), Convention("go", ("go",), r"(?:Service|Repository|Store)$", ("struct", "interface"), r"/?(?:services?|repository|store|pkg)/", 0.8, 0.8),
    Convention("go", ("go",), r"Middleware$|^Auth|^Log", ("function",), r"/?middlewares?/", 0.75, 0.75), Convention("go", ("go",), r"^[A-Z][a-zA-Z]+$", ("struct",), r"/?(?:models?|entity|entities|domain|pkg)/", 0.7, 0.7),
    Convention("rust", ("rust",), r"_handler$|^handle_", ("function",), r"/(?:handlers?|api|routes|controllers)/", 0.8, 0.8), Convention("rust", ("rust",), r"(?:Service|Repository)$", ("struct", "trait"), r"/(?:services?|repository|domain)/", 0.8, 0.8),
    Convention("rust", ("rust",), r"^[A-Z][a-zA-Z]+$", ("struct",), r"/(?:models?|entities|entity|domain|types)/", 0.7, 0.7),
    Convention("aspnet", ("csharp",), r"Controller$", ("class",), r"/Controllers/", 0.85, 0.85), Convention("aspnet", ("csharp",), r"Service$|^I.", ("class", "interface"), r"/(?:Services?|Application)/", 0.85, 0.85),
    Convention("aspnet", ("csharp",), r"Repository$", ("class", "interface"), r"/(?:Repositories|Repository|Data|Infrastructure)/", 0.85, 0.85), Convention("aspnet", ("csharp",), r"^[A-Z][a-zA-Z]+$", ("class",), r"/(?:Models?|Entities|Entity|Domain)/", 0.7, 0.7),
    Convention("aspnet", ("csharp",), r"(?:ViewModel|Dto)$", ("class",), r"/(?:ViewModels?|DTOs|Dto)/", 0.8, 0.8),
]


def detected(files: DataFrame, more: Sequence[Mark] = ()) -> DataFrame:
    """framework, each once: those whose marks some file (path, text) bears; more marks may be given. A null text bears marks of its path alone."""
    rules = [*MARKS, *more]
    hit = [F.when(F.col("path").rlike(m.path) & (F.lit(True) if m.text is None else F.coalesce(F.col("text").rlike(m.text), F.lit(False))), F.lit(m.framework)) for m in rules]
    return files.select(F.explode(F.array_distinct(F.array_compact(F.array(*hit)))).alias("framework")).distinct()


def by_convention(refs: DataFrame, nodes: DataFrame, frameworks: DataFrame, more: Sequence[Convention] = ()) -> DataFrame:
    """ref_id, target, confidence, resolved_by of references that a framework's habits answer; at most one row for each.

    refs: ref_id, reference_name, language. frameworks: framework. Of one framework the first convention with an answer holds; of several frameworks the first
    that is sure (0.9 and more), else the surest. Of several nodes the best placed is taken, then the least by path and id. Conventions in more come
    after those of CONVENTIONS, and take the place of all of a framework's if they bear its name.
    """
    replaced = {c.framework for c in more}
    rules = [*(c for c in CONVENTIONS if c.framework not in replaced), *more]
    order = list(dict.fromkeys(c.framework for c in rules))
    key = lambda c: F.regexp_replace("reference_name", F.lit(c.name), F.lit(c.key)) if c.key else F.col("reference_name")
    asks = [F.when(F.col("language").isin(*c.languages) & F.col("reference_name").rlike(c.name), F.struct(F.lit(k).alias("rule"), F.lit(c.framework).alias("framework"), key(c).alias("key"))) for k, c in enumerate(rules)]
    asked = refs.select("ref_id", F.explode(F.array_compact(F.array(*asks))).alias("r")).select("ref_id", "r.*").join(frameworks.select("framework").distinct(), "framework", "left_semi")
    parts = F.split("qualified_name", r"::|\.")
    held = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "::"))
    bearers = nodes.filter(F.col("kind").isin(*{k for c in rules for k in c.kinds})).select("id", "kind", "file_path", F.explode(F.array_distinct(F.array_compact(F.array("name", held)))).alias("key"))
    met = bearers.join(asked.select("rule", "key").distinct(), "key")
    of = lambda value: reduce(lambda when, kc: when.when(F.col("rule") == kc[0], value(kc[1])), enumerate(rules), F.when(F.lit(False), value(rules[0])))
    placed = met.filter(of(lambda c: F.col("kind").isin(*c.kinds))).withColumn("placed", of(lambda c: F.col("file_path").rlike(c.place)))
    sure = placed.withColumn("confidence", F.when(F.col("placed"), of(lambda c: F.lit(float(c.confidence)))).otherwise(of(lambda c: F.lit(float(c.otherwise))))).filter("confidence > 0")
    best = sure.groupBy("rule", "key").agg(F.min_by(F.struct(F.col("id").alias("target"), "confidence"), F.struct(~F.col("placed"), "file_path", "id")).alias("b"))
    answers = asked.join(best, ["rule", "key"]).select("ref_id", "framework", "rule", "b.target", "b.confidence")
    each = answers.groupBy("ref_id", "framework").agg(F.min_by(F.struct("target", "confidence"), "rule").alias("b"))
    rank = F.array_position(F.array(*(F.lit(f) for f in order)), F.col("framework"))
    first = each.groupBy("ref_id").agg(F.min_by("b", F.struct(F.when(F.col("b.confidence") >= 0.9, 0.0).otherwise(1 - F.col("b.confidence")), rank)).alias("b"))
    return first.select("ref_id", "b.target", "b.confidence", F.lit("framework").alias("resolved_by"))


def _section(name: str) -> Column:
    return F.regexp_extract("bare", rf"(?ms)^\s*\[{name}\]\s*$(.*?)(?=^\s*\[|\z)", 1)


def crates(files: DataFrame) -> DataFrame:
    """crate, folder of the members of the Cargo workspace whose manifest is `Cargo.toml`; members may be globs. A crate's name also counts with `_` for `-`.

    Patterns meet the folders of manifests by the folder before their first glob sign, as one of the folders above. Two members of one name: the least folder.
    """
    uncommented = F.regexp_replace("text", F.lit(r"(?m)^((?:[^#\"'\n]|\"[^\"\n]*\"|'[^'\n]*')*)#.*$"), F.lit("$1"))
    manifests = files.filter(F.col("path").rlike(r"(?:^|/)Cargo\.toml$")).select("path", uncommented.alias("bare"))
    listed = F.regexp_extract(_section("workspace"), r"(?s)\bmembers\s*=\s*\[((?:[^\]\"']|\"[^\"]*\"|'[^']*')*)\]", 1)
    members = manifests.filter("path = 'Cargo.toml'").select(F.explode(F.regexp_extract_all(listed, F.lit(r"[\"']([^\"'\n]+)[\"']"), F.lit(1))).alias("member"))
    clean = F.regexp_replace(F.regexp_replace("member", F.lit(r"\\"), F.lit("/")), F.lit(r"/$"), F.lit(""))
    regex = F.regexp_replace(clean, F.lit(r"([.+^$()|{}\[\]\\])"), F.lit(r"\\$1"))
    for sign, by in (("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/.][^/]*"), ("?", "[^/]"), ("\u0001", "(?:[^/.][^/]*/)*"), ("\u0002", ".*")):
        regex = F.replace(regex, F.lit(sign), F.lit(by))
    above = F.regexp_replace(F.regexp_extract(clean, r"^([^*?]*)", 1), F.lit(r"/?[^/]*$"), F.lit(""))
    patterns = members.select(above.alias("above"), F.concat(F.lit("^"), regex, F.lit("$")).alias("regex")).distinct()
    named = manifests.select(F.regexp_replace("path", F.lit(r"/?Cargo\.toml$"), F.lit("")).alias("folder"), F.regexp_extract(_section("package"), r"\bname\s*=\s*[\"']([^\"'\n]+)[\"']", 1).alias("crate")).filter("crate <> '' AND folder <> ''")
    steps = F.split("folder", "/")
    over = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    found = named.withColumn("above", F.explode(over)).join(patterns, "above").filter(F.regexp_like(F.col("folder"), F.col("regex")))
    both = found.select(F.explode(F.array_distinct(F.array("crate", F.replace("crate", F.lit("-"), F.lit("_"))))).alias("crate"), "folder")
    return both.groupBy("crate").agg(F.min("folder").alias("folder"))


def by_crate(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target, confidence, resolved_by: lower-case Rust names that are modules of the root crate (0.6) or members of its workspace (0.95). The target is a module of that file, else the file, else its first symbol."""
    own = refs.filter((F.col("language") == "rust") & F.col("reference_name").rlike(r"^[a-z_]+$")).select("ref_id", F.col("reference_name").alias("name"))
    names = own.select("name").distinct()
    places = lambda confidence, *paths: F.posexplode(F.array(*(F.struct(F.concat(*p).alias("file_path"), F.lit(confidence).alias("confidence")) for p in paths))).alias("n", "p")
    near = names.select("name", places(0.6, (F.lit("src/"), "name", F.lit(".rs")), (F.lit("src/"), "name", F.lit("/mod.rs"))))
    far = names.join(crates(files).withColumnRenamed("crate", "name"), "name").select("name", places(0.95, ("folder", F.lit("/src/lib.rs")), ("folder", F.lit("/src/main.rs"))))
    tried = near.unionByName(far.withColumn("n", F.col("n") + 2)).select("name", "n", "p.*")
    hits = tried.join(nodes.select("id", "kind", "file_path", "start_line"), "file_path")
    first = hits.groupBy("name").agg(F.min_by(F.struct(F.col("id").alias("target"), "confidence"), F.struct("n", F.col("kind") != "module", F.col("kind") != "file", "start_line", "id")).alias("b"))
    return own.join(first, "name").select("ref_id", "b.target", "b.confidence", F.lit("framework").alias("resolved_by"))


def by_framework(refs: DataFrame, nodes: DataFrame, files: DataFrame, marks: Sequence[Mark] = (), conventions: Sequence[Convention] = ()) -> DataFrame:
    """What the frameworks that files show answer of refs: conventions, then crates where a Cargo.toml is. As by_convention."""
    used = detected(files, marks)
    first = by_convention(refs, nodes, used, conventions)
    rust = F.array(F.lit("rust")) if not used.filter("framework = 'rust'").isEmpty() else F.array().cast("array<string>")
    crate = by_crate(refs.filter(F.array_contains(rust, F.col("language"))), nodes, files)
    both = first.withColumn("order", F.lit(0)).unionByName(crate.withColumn("order", F.lit(1)))
    one = both.groupBy("ref_id").agg(F.min_by(F.struct("target", "confidence", "resolved_by"), F.struct(-F.col("confidence"), "order")).alias("b"))
    return one.select("ref_id", "b.*")

