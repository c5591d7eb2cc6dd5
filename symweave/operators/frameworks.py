"""Frameworks: which symbol a route leads to, routes that folders make, and components.

A handler either stands on the line of its route, or is the next function or method below it, as with decorators and attributes. Nest's routes begin with
what the class around them says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..schema import node_id
from .extract import RUNES, lines, routes

#: framework, pattern of the handler on the line of the route; others have it below
NAMED = {
    "express": r",\s*(?:[\w$]+\.)*([\w$]+)\s*\)\s*;?\s*$",
    "django": r"\(\s*r?['\"][^'\"]*['\"]\s*,\s*(?!include\b)(?:\w+\.)*?(\w+)(?:\.as_view\(.*?\))?\s*[,)]",
    "laravel": r"(?:@|::class\s*,\s*['\"])(\w+)['\"]",
    "rails": r"(?:to:|=>)\s*['\"][\w/]+#(\w+)['\"]",
    "gin": r"\"\s*,\s*(?:.*,\s*)?(?:\w+\.)?(\w+)\s*\)\s*$",
    "axum": r"\b(?:get|post|put|patch|delete)\(\s*(?:\w+::)*(\w+)\s*\)",
    "vapor": r"use:\s*(?:\w+\.)*(\w+)",
    "aspnet": r"\.Map\w+\(\s*\"[^\"]*\"\s*,\s*(?:\w+\.)*(\w+)\s*\)",
}
BELOW = ("flask", "spring", "actix", "aspnet")
#: arguments in brackets, with strings and up to two more levels of brackets inside
_STRINGS = r"'[^']*+'|\"[^\"]*+\"|`[^`]*+`"
_INSIDE = rf"(?:[^()'\"`]++|{_STRINGS}|\((?:[^()'\"`]++|{_STRINGS}|\((?:[^()'\"`]++|{_STRINGS})*+\))*+\))*+"
ARGS, ARGS_KEPT = rf"\({_INSIDE}\)", rf"\(({_INSIDE})\)"
# Decorators of Nest, on classes and on what they route to, and the words for its messages.
NEST_SCOPES = rf"^\s*(?:@\w+{ARGS}\s*)*@(Controller|Resolver|WebSocketGateway|Injectable|Module|Catch)\s*{ARGS_KEPT}"
NEST_ROUTES = rf"^\s*(?:@\w+{ARGS}\s*)*?@(Get|Post|Put|Patch|Delete|Head|Options|All|Query|Mutation|Subscription|MessagePattern|EventPattern|SubscribeMessage)\s*{ARGS_KEPT}"
NEST_WORDS = {"MessagePattern": "MESSAGE", "EventPattern": "EVENT", "SubscribeMessage": "WS"}
GRAPHQL = ("Query", "Mutation", "Subscription")
# What a resource stands for, as framework, action, method, what follows the resource's path, and whether an interface without forms has it.
RESOURCES = [
    ("laravel", "index", "GET", "", True), ("laravel", "create", "GET", "/create", False), ("laravel", "store", "POST", "", True), ("laravel", "show", "GET", "/{id}", True),
    ("laravel", "edit", "GET", "/{id}/edit", False), ("laravel", "update", "PUT", "/{id}", True), ("laravel", "destroy", "DELETE", "/{id}", True),
    ("rails", "index", "GET", "", True), ("rails", "new", "GET", "/new", False), ("rails", "create", "POST", "", True), ("rails", "show", "GET", "/:id", True),
    ("rails", "edit", "GET", "/:id/edit", False), ("rails", "update", "PATCH", "/:id", True), ("rails", "destroy", "DELETE", "/:id", True),
]
INCLUDES = r"\binclude\(\s*['\"]([\w.]+)['\"]"
#: framework, pattern of the path, what is a page's place in it
PAGES = [
    ("next", r"(?:^|/)pages/(?!_)(.+)\.(?:tsx|jsx|ts|js)$"),
    ("next", r"(?:^|/)app/(.*?)/?(?:page|route)\.(?:tsx|jsx|ts|js)$"),
    ("sveltekit", r"(?:^|/)src/routes/(.*?)/?\+(?:page|server)(?:\.server)?\.(?:svelte|ts|js)$"),
    ("nuxt", r"(?:^|/)pages/(.+)\.vue$"),
    ("nuxt", r"(?:^|/)server/(api/.+?)(?:\.(?:get|post|put|patch|delete))?\.(?:ts|js)$"),
]
SCREEN = r":\s*(?:some\s+)?(View|UIViewController|UITableViewController|UICollectionViewController|UIView)\b"


def handlers(files: DataFrame, found: DataFrame) -> DataFrame:
    """id, framework, path, line, method, url, handler: what each route leads to; null where it can't be told. found: symbols of the files."""
    named = F.coalesce(*(F.when(F.col("framework") == name, F.nullif(F.regexp_extract("text", p, 1), F.lit(""))) for name, p in NAMED.items()))
    text = lines(files)
    own = routes(files).join(text.select("path", "line", "text"), ["path", "line"]).withColumn("named", named).drop("text").unionByName(_nest(text), allowMissingColumns=True)
    # next function below: routes and functions of a file in one order of lines
    marks = found.filter("kind IN ('function', 'method')").select(F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.col("name").alias("next"))
    both = own.unionByName(marks, allowMissingColumns=True)
    by_line = Window.partitionBy("path").orderBy("line")
    onward, before = by_line.rowsBetween(0, Window.unboundedFollowing), by_line.rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("next", F.first("next", ignorenulls=True).over(onward)).withColumn("scope", F.last("scope", ignorenulls=True).over(before)).filter("framework IS NOT NULL")
    handler = F.coalesce("named", F.when(F.col("framework").isin(*BELOW, "nest"), F.col("next")))
    composed = _composed(placed.withColumn("handler", handler))
    return composed.select(node_id(F.lit("route"), F.col("path"), F.concat_ws(" ", "method", "url"), F.col("line")).alias("id"), "framework", "path", "line", "method", "url", "handler")


def _literal(args: str, *keys: str) -> Column:
    """The first string after one of the keys, in their order (`` is any place, `^` the beginning); empty if there is none."""
    before = {"": "", "^": r"^\s*"}
    return F.coalesce(*(F.nullif(F.regexp_extract(args, before.get(k, rf"\b{k}\s*:\s*") + r"['\"`]([^'\"`]*)['\"`]", 1), F.lit("")) for k in keys), F.lit(""))


def _nest(text: DataFrame) -> DataFrame:
    """path, line, framework, method, args of routes, and path, line, scope (kind, prefix) of the classes around: a class's scope goes to the next class's."""
    script = text.filter(F.col("language").isin("typescript", "javascript", "tsx", "jsx") & F.col("text").contains("@"))
    scope, args = F.regexp_extract("text", NEST_SCOPES, 1), F.regexp_extract("text", NEST_SCOPES, 2)
    around = script.withColumn("kind", scope).withColumn("args", args).filter("kind <> ''")
    prefix = F.when(F.col("kind") == "Controller", _literal("args", "path", "")).when(F.col("kind") == "WebSocketGateway", _literal("args", "namespace")).otherwise("")
    classes = around.select("path", "line", F.struct("kind", prefix.alias("prefix")).alias("scope"))
    hits = script.select("path", "line", F.lit("nest").alias("framework"), F.regexp_extract("text", NEST_ROUTES, 1).alias("method"), F.regexp_extract("text", NEST_ROUTES, 2).alias("args")).filter("method <> ''")
    return classes.unionByName(hits, allowMissingColumns=True)


def _composed(placed: DataFrame) -> DataFrame:
    """placed with Nest's methods and urls made from the class around: prefixes of controllers and namespaces of gateways; GraphQL only in resolvers."""
    nest, kind, prefix = F.col("framework") == "nest", F.col("scope.kind"), F.coalesce("scope.prefix", F.lit(""))
    graphql = F.col("method").isin(*GRAPHQL)
    trimmed = lambda c: F.regexp_replace(F.trim(c), F.lit(r"^/+|/+$"), F.lit(""))
    whole = F.filter(F.array(trimmed(F.when(kind == "Controller", prefix).otherwise("")), trimmed(_literal("args", ""))), lambda p: p != "")
    or_handler = lambda c: F.coalesce(F.nullif(c, F.lit("")), "handler", F.lit(""))
    event = or_handler(_literal("args", ""))
    url = (
        F.when(graphql, or_handler(_literal("args", "name", "^"))).when(F.col("method").isin("MessagePattern", "EventPattern"), event)
        .when(F.col("method") == "SubscribeMessage", F.when((kind == "WebSocketGateway") & (prefix != ""), F.concat_ws(":", prefix, event)).otherwise(event))
        .otherwise(F.concat(F.lit("/"), F.array_join(whole, "/")))
    )
    word = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NEST_WORDS.items() for x in kv)), F.col("method")), F.upper("method"))
    kept = placed.filter(~nest | ~graphql | F.coalesce(kind == "Resolver", F.lit(False)))
    return kept.withColumn("url", F.when(nest, url).otherwise(F.col("url"))).withColumn("method", F.when(nest, word).otherwise(F.col("method")))


def resources(handled: DataFrame) -> DataFrame:
    """id, framework, path, line, method, url, handler of the routes that resource routes of handled stand for: `Route::resource`, `Route::apiResource`, `resources`. Their ids lead back to the resource."""
    whole = handled.filter(F.lower("method").isin("resource", "apiresource", "resources"))
    actions = F.array(*(F.struct(F.lit(f).alias("of"), F.lit(a).alias("handler"), F.lit(m).alias("verb"), F.lit(u).alias("rest"), F.lit(api).alias("api")) for f, a, m, u, api in RESOURCES))
    own = whole.withColumn("a", F.explode(actions)).filter((F.col("a.of") == F.col("framework")) & (F.col("a.api") | (F.lower("method") != "apiresource")) & ~((F.col("framework") == "rails") & (F.lower("method") == "resource")))
    url = F.concat(F.lit("/"), F.regexp_replace("url", F.lit(r"^/+|/+$"), F.lit("")), F.col("a.rest"))
    return own.select("id", "framework", "path", "line", F.col("a.verb").alias("method"), url.alias("url"), F.col("a.handler").alias("handler"))


def route_nodes(handled: DataFrame, files: DataFrame) -> DataFrame:
    """A node for each route, named by its method and path."""
    name = F.concat_ws(" ", "method", "url")
    own = handled.join(files.select("path", "language"), "path")
    return own.select("id", F.lit("route").alias("kind"), name.alias("name"), F.concat_ws("::", "path", name).alias("qualified_name"), F.col("path").alias("file_path"), "language", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(True).alias("is_exported"))


def route_references(handled: DataFrame, files: DataFrame) -> DataFrame:
    """from_node_id, reference_name, reference_kind, line, file_path, language: from routes to their handlers, and from files to the route files that they include."""
    to = handled.filter("handler IS NOT NULL").select(F.col("id").alias("from_node_id"), F.col("handler").alias("reference_name"), F.lit("references").alias("reference_kind"), "line", "path")
    included = lines(files.filter("language = 'python'")).withColumn("name", F.regexp_extract("text", INCLUDES, 1)).filter("name <> ''")
    parts = included.select(F.concat(F.lit("file:"), "path").alias("from_node_id"), F.col("name").alias("reference_name"), F.lit("imports").alias("reference_kind"), "line", "path")
    return to.unionByName(parts).join(files.select("path", "language"), "path").withColumnRenamed("path", "file_path").select("from_node_id", "reference_name", "reference_kind", "line", "file_path", "language")


def page_routes(files: DataFrame) -> DataFrame:
    """framework, path, url of files that are pages or endpoints by their place: `[id]` becomes `:id`, `[...rest]` becomes `*`, `(group)` and `index` go."""
    parts = [files.filter(F.col("path").rlike(p)).select(F.lit(name).alias("framework"), "path", F.regexp_extract("path", p, 1).alias("place")) for name, p in PAGES]
    url = F.col("place")
    for pattern, by in ((r"(?:^|/)\([^)]*\)", ""), (r"\[\[?\.\.\.\w+\]?\]", "*"), (r"\[\[?(\w+)\]?\]", ":$1"), (r"(?:^|/)index$", ""), (r"^/+|/+$", "")):
        url = F.regexp_replace(url, F.lit(pattern), F.lit(by))
    return reduce(DataFrame.unionByName, parts).select("framework", "path", F.concat(F.lit("/"), url).alias("url"))


def components(files: DataFrame, found: DataFrame) -> DataFrame:
    """id, framework, kind, name, file_path, start_line: a component for each Vue or Svelte file, capitalised functions and classes of JSX files, `use…` functions as hooks, and Swift screens."""
    whole = files.filter("language IN ('svelte', 'vue')").select(F.col("language").alias("framework"), F.lit("component").alias("kind"), F.regexp_replace(base_name(F.col("path")), F.lit(r"\.\w+$"), F.lit("")).alias("name"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"))
    script = found.filter(F.col("language").isin("tsx", "jsx", "typescript", "javascript") & F.col("kind").isin("function", "class"))
    hook = (F.col("kind") == "function") & F.col("name").rlike("^use[A-Z]")
    drawn = F.col("language").isin("tsx", "jsx") & F.col("name").rlike("^[A-Z]")
    react = script.filter(hook | drawn).select(F.lit("react").alias("framework"), F.when(hook, "function").otherwise("component").alias("kind"), "name", "file_path", "start_line")
    swift = found.filter((F.col("language") == "swift") & F.col("kind").isin("struct", "class") & F.col("signature").rlike(SCREEN)).select(F.lit("swift").alias("framework"), F.lit("component").alias("kind"), "name", "file_path", "start_line")
    every = whole.unionByName(react).unionByName(swift)
    return every.select(node_id(F.col("kind"), F.col("file_path"), F.col("name"), F.col("start_line")).alias("id"), "framework", "kind", "name", "file_path", "start_line")


def project_references(refs: DataFrame) -> DataFrame:
    """refs without the names that a framework itself provides: React's own hooks and Svelte's runes."""
    hooks = ("useState", "useEffect", "useMemo", "useCallback", "useRef", "useContext", "useReducer", "useLayoutEffect", "useId", "useTransition", "useDeferredValue")
    return refs.filter(~(F.col("reference_name").isin(*hooks) | (F.col("language") == "svelte") & F.col("reference_name").rlike(RUNES)))
