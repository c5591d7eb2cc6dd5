"""Extraction of symbols and references from source text, by rules for each language.

A file becomes rows of statements (`lexing`), which may span lines and hold no comments; each rule is a regular expression that a statement may match, so
extraction is a narrow transformation. A symbol's parent is the nearest earlier symbol that is indented less, found with a stack over each file's
statements. There is no full parser here: the rules see how declarations begin.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import node_id
from .lexing import scanned


class Rule(NamedTuple):
    language: str
    kind: str
    pattern: str  # group 1 is the name


SYMBOL_SCHEMA = (
    "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean, indent int, signature string, parent_id string, docstring string"
)
PARENTS = ("class", "interface", "struct", "trait", "enum", "module", "protocol", "function", "method", "component")
MARKERS = r"^\s*(?:/\*+|\*+/|\*+|//[/!]*|#+|-{2,})\s?|\*+/\s*$"
GOES_ON = r"^\s*(?:[{}\])]|(?i:end)\b)"
DECORATOR = r"^\s*(?:@|#\[|\[[A-Z])"
EXPORTED = r"^\s*(?:export|pub|public)\b"
RULES = [
    *(Rule(lang, kind, pattern) for lang in ("typescript", "tsx", "javascript", "jsx") for kind, pattern in (
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
        ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
        ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
        ("type_alias", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)[^=]*="),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)"),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
        ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b)([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;]+)?\{\s*$"),
        ("import", r"^\s*(?:import\b.*?from\s*|import\s*|export\b.*?from\s*)['\"]([^'\"]+)['\"]"),
    )),
    Rule("python", "class", r"^\s*class\s+([A-Za-z_]\w*)"), Rule("python", "function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)"), Rule("python", "method", r"^\s+(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    Rule("python", "import", r"^\s*(?:from|import)\s+([\w.]+)"),
    Rule("go", "function", r"^func\s+([A-Za-z_]\w*)\s*[\[(]"), Rule("go", "method", r"^func\s+\([^)]*\)\s+([A-Za-z_]\w*)"), Rule("go", "struct", r"^type\s+([A-Za-z_]\w*)\s+struct\b"), Rule("go", "interface", r"^type\s+([A-Za-z_]\w*)\s+interface\b"), Rule("go", "import", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"),
    Rule("rust", "function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+([A-Za-z_]\w*)"), Rule("rust", "method", r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+([A-Za-z_]\w*)"), Rule("rust", "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)"), Rule("rust", "trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_]\w*)"), Rule("rust", "enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_]\w*)"), Rule("rust", "import", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    *(Rule(lang, kind, pattern) for lang in ("java", "csharp", "kotlin", "scala") for kind, pattern in (
        ("class", r"^\s*(?:(?:public|private|protected|internal|abstract|final|static|sealed|open|data|case|partial)\s+)*(?:class|object|record)\s+([A-Za-z_]\w*)"),
        ("interface", r"^\s*(?:(?:public|private|protected|internal|sealed)\s+)*(?:interface|trait)\s+([A-Za-z_]\w*)"),
        ("enum", r"^\s*(?:(?:public|private|protected|internal|static)\s+)*enum\s+(?:class\s+)?([A-Za-z_]\w*)"),
        ("import", r"^\s*(?:import|using)\s+(?:static\s+)?([\w.]+)"),
    )),
    *(Rule(lang, "method", r"^\s+(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|synchronized)\s+)+[\w<>\[\],.? ]+\s+([A-Za-z_]\w*)\s*\([^;]*$") for lang in ("java", "csharp")),
    *(Rule(lang, "function", r"^\s*(?:(?:public|private|protected|internal|override|suspend|inline|open|implicit|final)\s+)*(?:fun|def)\s+(?:<[^>]*>\s*)?(?:\w+\.)?([A-Za-z_]\w*)") for lang in ("kotlin", "scala")),
    Rule("csharp", "struct", r"^\s*(?:(?:public|private|internal|readonly)\s+)*struct\s+([A-Za-z_]\w*)"),
    *(Rule(lang, kind, pattern) for lang in ("c", "cpp") for kind, pattern in (
        ("struct", r"^\s*(?:typedef\s+)?struct\s+([A-Za-z_]\w*)\s*\{?"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?([A-Za-z_]\w*)"),
        ("function", r"^(?!\s*(?:return|else|if|for|while|switch)\b)[A-Za-z_][\w\s*&:<>,]*?\b([A-Za-z_]\w*)\s*\([^;]*$"), ("import", r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]"),
    )),
    Rule("cpp", "class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+([A-Za-z_]\w*)"),
    Rule("php", "class", r"^\s*(?:abstract\s+|final\s+)?(?:class|trait)\s+([A-Za-z_]\w*)"), Rule("php", "interface", r"^\s*interface\s+([A-Za-z_]\w*)"), Rule("php", "enum", r"^\s*enum\s+([A-Za-z_]\w*)"), Rule("php", "function", r"^function\s+&?([A-Za-z_]\w*)"), Rule("php", "method", r"^\s+(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?([A-Za-z_]\w*)"), Rule("php", "import", r"^\s*use\s+([\w\\]+)"),
    Rule("ruby", "class", r"^\s*class\s+([A-Z]\w*)"), Rule("ruby", "module", r"^\s*module\s+([A-Z]\w*)"), Rule("ruby", "method", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"), Rule("ruby", "import", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
    Rule("swift", "class", r"^\s*(?:(?:public|open|final|private|internal)\s+)*class\s+(?!func\b)([A-Za-z_]\w*)"), Rule("swift", "struct", r"^\s*(?:(?:public|private|internal)\s+)*struct\s+([A-Za-z_]\w*)"), Rule("swift", "protocol", r"^\s*(?:(?:public|private|internal)\s+)*protocol\s+([A-Za-z_]\w*)"), Rule("swift", "enum", r"^\s*(?:(?:public|private|internal|indirect)\s+)*enum\s+([A-Za-z_]\w*)"), Rule("swift", "function", r"^\s*(?:(?:public|private|internal|static|override|mutating|class|open)\s+)*func\s+([A-Za-z_]\w*)"), Rule("swift", "import", r"^\s*import\s+([\w.]+)"),
    Rule("dart", "class", r"^\s*(?:abstract\s+)?(?:class|mixin)\s+([A-Za-z_]\w*)"), Rule("dart", "enum", r"^\s*enum\s+([A-Za-z_]\w*)"), Rule("dart", "function", r"^(?:[\w<>?,\[\] ]+\s+)([a-z_]\w*)\s*\([^;]*\)\s*(?:async\s*)?\{\s*$"), Rule("dart", "import", r"^\s*(?:import|export)\s+['\"]([^'\"]+)['\"]"),
    *(Rule(lang, kind, pattern) for lang in ("lua", "luau") for kind, pattern in (("function", r"^\s*(?:local\s+)?function\s+([A-Za-z_][\w.:]*)"), ("import", r"require\s*\(?\s*['\"]([^'\"]+)['\"]"))),
    Rule("pascal", "class", r"(?i)^\s*([A-Za-z_]\w*)\s*=\s*class\b"), Rule("pascal", "interface", r"(?i)^\s*([A-Za-z_]\w*)\s*=\s*interface\b"), Rule("pascal", "function", r"(?i)^\s*(?:procedure|function|constructor|destructor)\s+([A-Za-z_][\w.]*)"), Rule("pascal", "import", r"(?i)^\s*uses\s+([\w.]+)"),
    *(Rule(lang, kind, pattern) for lang in ("svelte", "vue") for kind, pattern in (("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"), ("import", r"^\s*import\b.*?from\s*['\"]([^'\"]+)['\"]"))),
    *(Rule(lang, kind, pattern) for lang in ("svelte", "vue") for kind, pattern in (("class", r"^\s*(?:export\s+)?class\s+([A-Za-z_$][\w$]*)"), ("property", r"^\s*export\s+let\s+([A-Za-z_$][\w$]*)"), ("variable", r"^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)"))),
    Rule("pascal", "component", r"^\s*(?:object|inherited|inline)\s+(\w+)\s*:\s*\w+\s*$"),
    Rule("liquid", "constant", r"\{%-?\s*(schema)\s*-?%\}"), Rule("liquid", "import", r"\{%-?\s*(?:render|include|section)\s+['\"]([^'\"]+)['\"]"), Rule("liquid", "variable", r"\{%-?\s*assign\s+([A-Za-z_]\w*)"),
]
#: kind of reference, pattern; group 1 is what is referred to
REFERENCES = [
    ("instantiates", r"\bnew\s+([A-Za-z_$][\w$.]*)"), ("calls", r"(?<![\w$.])(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|def\b|class\b|new\b|fn\b|func\b|elif\b|super\b|match\b)((?:[A-Za-z_$][\w$]*\.)?[A-Za-z_$][\w$]*)\s*\("),
    ("extends", r"\b(?:class|interface|trait|struct)\s+\w+(?:<[^>]*>)?\s+extends\s+([A-Za-z_$][\w$.]*)"), ("extends", r"^\s*class\s+\w+\s*\(\s*([A-Za-z_][\w.]*)"), ("implements", r"\bimplements\s+([A-Za-z_$][\w$.]*)"), ("decorates", r"^\s*@([A-Za-z_$][\w$.]*)"),
]
#: languages, kind, pattern of what only they refer to
TYPED = ("typescript", "tsx", "kotlin", "scala", "swift", "rust", "python", "php", "svelte", "vue")
DECLARED = ("java", "csharp", "dart", "c", "cpp", "go")
OWN_REFERENCES = [
    (TYPED, "references", r"(?:(?<!:):(?!:)|->)\s*(?:[&?*]|mut\s|dyn\s|readonly\s)*\s*([A-Z]\w*)"), ((*TYPED, *DECLARED), "references", r"<\s*([A-Z]\w*)(?=[\w<>,\s\[\]|&]*>\s*[\w\[({;,=:)])"),
    (DECLARED, "references", r"[(,]\s*(?:final\s+|const\s+|ref\s+|out\s+)*(?:\w+\s+\*?)??([A-Z]\w*)(?:<[^>]*>|\[\])?(?=\s+[a-z_]\w*|[,)]\s*)"), (("tsx", "jsx", "svelte", "vue"), "references", r"<([A-Z][\w.]*)[\s/>]"),
    (("pascal",), "references", r"^\s*On\w+\s*=\s*(\w+)\s*$"), (("liquid",), "references", r"\{%-?\s*(?:render|include|section)\s+['\"]([^'\"]+)['\"]"),
]
#: What no node of a project stands for: types of the languages themselves, and what Svelte calls runes.
OWN_TYPES = "String Number Boolean Object Array Promise Record Partial Readonly Map Set Date Error Function Symbol Any Int Integer Long Short Byte Float Double Char Bool Void Unit Option Some None Result Ok Err Vec Box Rc Arc List Optional Self True False".split()
RUNES = r"^\$(state|derived|effect|props|bindable|inspect|host)\b"
#: framework, language, pattern: groups are the method (or empty) and the path
ROUTES = [
    ("express", ("javascript", "typescript"), r"\b(?:app|router)\.(get|post|put|patch|delete|all|use)\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("flask", ("python",), r"@\w+\.(route|get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"), ("django", ("python",), r"\b(path|re_path|url)\(\s*r?['\"]([^'\"]*)['\"]"),
    ("laravel", ("php",), r"Route::(get|post|put|patch|delete|any|resource|apiResource)\(\s*['\"]([^'\"]+)['\"]"), ("rails", ("ruby",), r"^\s*(get|post|put|patch|delete|resources?)\s+['\":]+([\w/:.-]+)"),
    ("spring", ("java", "kotlin"), r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?['\"]([^'\"]+)['\"]"), ("gin", ("go",), r"\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|HandleFunc)\(\s*\"([^\"]+)\""),
    ("actix", ("rust",), r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\""), ("axum", ("rust",), r"\.(route)\(\s*\"([^\"]+)\""), ("aspnet", ("csharp",), r"(?:\[Http|\.Map)(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\""), ("vapor", ("swift",), r"\bapp\.(get|post|put|patch|delete)\(\s*\"([^\"]+)\""),
]
# File name endings and their languages.
EXTENSIONS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "py": "python", "pyw": "python", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "rake": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "dart": "dart",
    "svelte": "svelte", "vue": "vue", "liquid": "liquid", "pas": "pascal", "dpr": "pascal", "dfm": "pascal", "fmx": "pascal", "scala": "scala", "sc": "scala", "lua": "lua", "luau": "luau",
}
CPP_MARK = r"\b(class|namespace|template|public:|private:|virtual)\b"


def language_of(path: Column, text: Column | None = None) -> Column:
    """By the ending of the path; a header counts as C++ if its first 8192 characters look so. Others are `unknown`."""
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    by_end = F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))
    if text is None:
        return by_end
    return F.when(F.lower(path).endswith(".h") & F.substr(text, F.lit(1), F.lit(8192)).rlike(CPP_MARK), "cpp").otherwise(by_end)


def lines(files: DataFrame) -> DataFrame:
    """path, language, line, text, bare for each statement: its first line, its code on one line, and the same with the content of strings blanked."""
    return scanned(files).filter("NOT is_comment").select("path", "language", "line", "text", "bare")


def file_nodes(files: DataFrame) -> DataFrame:
    """A node for each file."""
    n = F.size(F.split("text", "\n"))
    return files.select(
        F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("qualified_name"), F.col("path").alias("file_path"),
        "language", F.lit(1).alias("start_line"), n.alias("end_line"), F.lit(False).alias("is_exported"), F.lit(-1).alias("indent"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"),
    )


def symbols(files: DataFrame) -> DataFrame:
    """Nodes with parent_id, qualified_name (all containers around, `A::B::c`), end_line and docstring; files (path, language, text) themselves are not among them.

    Of several rules a statement fits, the first counts. A symbol ends before the next statement that is indented no more, brackets and `end` included. Comments right
    above it, or above its decorators, are its docstring. A file's statements meet in one group, which the size limit of files bounds.
    """
    shown = lambda r: "text" if r.kind == "import" or r.language == "liquid" else "bare"
    hits = [F.when((F.col("language") == r.language) & F.col(shown(r)).rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), F.regexp_extract(shown(r), r.pattern, 1).alias("name"))) for r in RULES]
    rows = scanned(files).withColumn("hit", F.when(~F.col("is_comment"), F.coalesce(*hits)))
    found = F.coalesce(F.col("hit.name"), F.lit("")) != ""
    rows = rows.select(
        "path", "language", "line", "end_line", "indent", "is_comment", F.when(found, F.col("hit.kind")).alias("kind"), F.when(found, F.col("hit.name")).alias("name"),
        F.when(found | F.col("is_comment"), F.trim("text")).alias("signature"),
        F.col("text").rlike(GOES_ON).alias("goes_on"), F.col("text").rlike(DECORATOR).alias("decorator"),
        (F.col("text").rlike(EXPORTED) | ((F.col("language") == "go") & F.col("hit.name").rlike("^[A-Z]")) | ((F.col("language") == "python") & ~F.col("hit.name").startswith("_"))).alias("is_exported"),
    )
    rows = rows.withColumn("id", F.when(F.col("name").isNotNull(), node_id(F.col("kind"), F.col("path"), F.col("name"), F.col("line"))))
    return rows.groupBy("path").applyInPandas(_nest, SYMBOL_SCHEMA)


def _nest(rows: pd.DataFrame) -> pd.DataFrame:
    """The symbols among a file's lines, each with what is around it, its end and the comments above."""
    out, around, above, before = [], [], [], 0
    for r in rows.sort_values("line").itertuples():
        if r.is_comment:
            above = [*above, r.signature] if above and before == r.line - 1 else [r.signature]
            before = r.line
            continue
        while around and (around[-1]["indent"] > r.indent or (around[-1]["indent"] == r.indent and not r.goes_on)):
            around.pop()
        for outer in around:
            outer["end_line"] = r.end_line
        if r.name:
            outer = [o for o in around if o["kind"] in PARENTS]
            out.append({
                "id": r.id, "kind": r.kind, "name": r.name, "qualified_name": "::".join([*(o["name"] for o in outer), r.name]), "file_path": r.path, "language": r.language, "start_line": r.line, "end_line": r.end_line,
                "is_exported": bool(r.is_exported), "indent": r.indent, "signature": r.signature, "parent_id": outer[-1]["id"] if outer else f"file:{r.path}",
                "docstring": "\n".join(t for t in (re.sub(MARKERS, "", c).strip() for c in above) if t) or None if above and before == r.line - 1 else None,
            })
            if r.kind != "import":
                around.append(out[-1])
        if not r.decorator:
            above = []
        before = r.end_line
    return pd.DataFrame(out, columns=[c.split()[0] for c in SYMBOL_SCHEMA.split(", ")])


def contains_edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit(None).cast("int").alias("line"))


def references(files: DataFrame, found: DataFrame) -> DataFrame:
    """from_node_id, reference_name, reference_kind, line, file_path, language: what statements refer to outside comments and strings, from the nearest symbol at or above them."""
    each = F.concat(*(F.transform(F.regexp_extract_all("bare", F.lit(p), F.lit(1)), _referring(kind)) for kind, p in REFERENCES))
    own_ = [F.when(F.col("language").isin(*languages), F.transform(F.regexp_extract_all("text" if languages[0] in ("pascal", "liquid") else "bare", F.lit(p), F.lit(1)), _referring(kind))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")) for languages, kind, p in OWN_REFERENCES]
    known = F.filter(F.concat(*own_), lambda r: ~r["name"].isin(*OWN_TYPES))
    called = F.filter(each, lambda r: (F.col("language") != "svelte") | ~r["name"].rlike(RUNES))
    rows = lines(files).select("path", "language", "line", F.explode(F.array_distinct(F.concat(called, known))).alias("r"))
    own = found.filter("kind <> 'import'").select(F.col("file_path").alias("path"), F.col("start_line").alias("at"), F.col("id").alias("from_id"), F.col("name").alias("own_name"))
    marks = own.select("path", F.col("at").alias("line"), "from_id", F.lit(0).alias("order"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"))
    asks = rows.select("path", "line", F.lit(None).cast("string").alias("from_id"), F.lit(1).alias("order"), "language", F.col("r.name").alias("name"), F.col("r.kind").alias("kind"))
    up_to = Window.partitionBy("path").orderBy("line", "order").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.unionByName(asks).withColumn("from_id", F.last("from_id", ignorenulls=True).over(up_to)).filter("order = 1")
    declared = own.select("path", F.col("at").alias("line"), F.col("own_name").alias("name"))
    calls = filled.join(declared, ["path", "line", "name"], "left_anti")
    plain = calls.select(
        F.coalesce("from_id", F.concat(F.lit("file:"), "path")).alias("from_node_id"), F.regexp_replace("name", F.lit(r"^(self|this|super)\."), F.lit("")).alias("reference_name"),
        F.col("kind").alias("reference_kind"), "line", F.col("path").alias("file_path"), "language",
    )
    imports = found.filter("kind = 'import'").select("parent_id", "name", "start_line", "file_path", "language").toDF("from_node_id", "reference_name", "line", "file_path", "language")
    return plain.unionByName(imports.withColumn("reference_kind", F.lit("imports")))


def _referring(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def routes(files: DataFrame) -> DataFrame:
    """framework, path, line, method, url for each route declaration."""
    found = [
        F.when(F.col("language").isin(*languages) & F.col("text").rlike(p), F.struct(F.lit(name).alias("framework"), F.upper(F.regexp_extract("text", p, 1)).alias("method"), F.regexp_extract("text", p, 2).alias("url")))
        for name, languages, p in ROUTES
    ]
    return lines(files).select("path", "line", F.explode(F.array_compact(F.array(*found))).alias("r")).select("r.framework", "path", "line", "r.method", "r.url")


def page_calls(pages: DataFrame) -> DataFrame:
    """page_id, name, n: the functions that a page's scripts call, and how often, comments and strings left out. A page without scripts has none."""
    scripts = pages.select(F.col("page_id"), F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("text"))
    rows = lines(scripts.select(F.col("page_id").cast("string").alias("path"), F.lit("javascript").alias("language"), "text"))
    calls = rows.select(F.col("path").cast("long").alias("page_id"), F.explode(F.regexp_extract_all("bare", F.lit(dict(REFERENCES)["calls"]), F.lit(1))).alias("name"))
    return calls.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


def page_elements(pages: DataFrame) -> DataFrame:
    """page_id, element, n, value: the title, links, headings and scripts of each page, in order."""
    rules = {"title": r"(?is)<title[^>]*>(.*?)</title>", "link": r"(?i)<a\s[^>]*href=\"([^\"]*)\"", "heading": r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "script": r"(?is)<script[^>]*>(.*?)</script>"}
    parts = [pages.select("page_id", F.lit(name).alias("element"), F.posexplode(F.regexp_extract_all("html", F.lit(p), F.lit(1))).alias("n", "value")) for name, p in rules.items()]
    return reduce(DataFrame.unionByName, parts)
