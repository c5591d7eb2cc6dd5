"""Answers, impacts and file trees as text. What is rendered whole is bounded by the limits of its query; file trees are rows, one for each line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import Answer

# Edges that a tree shows, and how many of a kind it names.
SHOWN = ("calls", "extends", "implements", "imports", "references")
NAMED, OTHERS, SIGNATURE = 3, 10, 50


def file_tree(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """place, depth, path, line: a line for each folder and file of files (path), drawn as a tree; in the order of place folders go first, then files, both by name.

    A folder's last child is found by aggregation, and branches are drawn by a join with the folders above, so that no folder is a task. Null and empty paths,
    and repeated ones, add nothing; what is both file and folder counts as a file. No deeper than max_depth.
    """
    parts = files.select(F.filter(F.split("path", "/"), lambda p: p != "").alias("parts")).filter(F.size("parts") > 0).distinct()
    steps = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")).filter(F.lit(True) if max_depth is None else F.col("depth") <= max_depth)
    own = F.slice("parts", F.lit(1), F.col("depth"))
    entries = steps.select(own.alias("parts"), (F.col("depth") == F.size("parts")).alias("is_file")).groupBy("parts").agg(F.max("is_file").alias("is_file"))
    at = F.struct("is_file", F.element_at("parts", -1).alias("name"))
    entries = entries.select("parts", F.slice("parts", F.lit(1), F.size("parts") - 1).alias("parent"), at.alias("at"))
    ends = entries.groupBy("parent").agg(F.max("at").alias("end"))
    placed = entries.join(ends, "parent").select("parts", "at", (F.col("at") == F.col("end")).alias("is_last"))
    above = placed.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")).select(F.col("parts").alias("of"), F.slice("parts", F.lit(1), F.col("depth")).alias("parts"))
    drawn = above.join(placed, "parts").groupBy("of").agg(F.array_sort(F.collect_list(F.struct(F.size("parts").alias("depth"), "at", "is_last"))).alias("way"))
    bars = F.transform(F.slice("way", F.lit(1), F.size("way") - 1), lambda w: F.when(w["is_last"], "    ").otherwise("│   "))
    me = F.element_at("way", -1)
    line = F.concat(F.array_join(bars, ""), F.when(me["is_last"], "└── ").otherwise("├── "), me["at"]["name"])
    return drawn.select(F.transform("way", lambda w: w["at"]).alias("place"), F.size("way").alias("depth"), F.array_join("of", "/").alias("path"), line.alias("line"))


def files_by_language(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """language, n, path, line: each file (path, language) with the number of its symbols and that of its language's files; languages with most files go first, files by path."""
    held = nodes.filter("kind <> 'file'").groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_symbols"))
    of = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    line = F.format_string("- %s (%d symbols)", "path", F.coalesce("n_symbols", F.lit(0)))
    return files.select("path", "language").join(held, "path", "left").join(of, "language").select("language", "n", "path", line.alias("line"))


def impact(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """root, file_path, n, text: for each root of reached (root, id) and file a line with its symbols and where they begin, and how many all files have together."""
    own = reached.select("root", "id").distinct().join(nodes.select("id", "name", "file_path", "start_line"), "id")
    total = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    said = _listed(F.struct(F.coalesce("start_line", F.lit(0)), "id", F.concat_ws(":", "name", "start_line").alias("text")), ", ")
    return own.groupBy("root", "file_path").agg(said.alias("names")).join(total, "root").select("root", "file_path", "n", F.concat(F.lit("**"), "file_path", F.lit(":** "), "names").alias("text"))


def _listed(ordered: Column, between: str = "\n") -> Column:
    """The texts of rows in their order; ordered: a struct whose field `text` comes last."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(ordered)), lambda r: r["text"]), between)


def _described(answer: Answer, nodes: DataFrame) -> DataFrame:
    own = nodes.select("id", "kind", "name", "file_path", "start_line", *(c for c in ("signature",) if c in nodes.columns))
    found = answer.nodes.join(own, "id")
    return found if "signature" in own.columns else found.withColumn("signature", F.lit(None).cast("string"))


def json(answer: Answer, nodes: DataFrame) -> DataFrame:
    """query_id, text: the answer as JSON: summary, counts, nodes (best first), edges and code blocks."""
    chosen = _described(answer, nodes).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "kind", "name", "file_path", "start_line", "signature", "role"))).alias("nodes"))
    shown = chosen.withColumn("nodes", F.transform("nodes", lambda n: n.dropFields("o")))
    edges = answer.edges.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "kind"))).alias("edges"))
    whole = answer.summary.join(shown, "query_id", "left").join(edges, "query_id", "left")
    if answer.blocks is not None:
        whole = whole.join(answer.blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "file_path", "start_line", "end_line", "code"))).alias("blocks")), "query_id", "left")
    return whole.select("query_id", F.to_json(F.struct(*whole.columns)).alias("text"))


def markdown(answer: Answer, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, text: the query, its entries with signatures, up to OTHERS further symbols by file, and the code of entries. Queries without an answer are left out."""
    found = _described(answer, nodes)
    where = F.concat_ws(":", "file_path", "start_line")
    signed = F.coalesce(F.concat(F.lit("\n  `"), F.nullif("signature", F.lit("")), F.lit("`")), F.lit(""))
    entry = F.concat(F.lit("- **"), "name", F.lit("** ("), "kind", F.lit(") - "), where, signed)
    entries = found.filter("role = 'entry'").groupBy("query_id").agg(_listed(F.struct(-F.col("score"), "id", entry.alias("text"))).alias("entries"))
    near = found.filter("role <> 'entry'").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "file_path", F.concat_ws(":", "name", "start_line").alias("own")))), 1, OTHERS).alias("few"))
    by_file = near.select("query_id", F.explode("few").alias("r")).groupBy("query_id", "r.file_path").agg(F.concat(F.lit("- "), F.first("r.file_path"), F.lit(": "), _listed(F.struct("r.o", "r.id", F.col("r.own").alias("text")), ", ")).alias("text"))
    others = by_file.groupBy("query_id").agg(_listed(F.struct("file_path", "text")).alias("others"))
    whole = queries.select("query_id", "query").join(entries, "query_id").join(others, "query_id", "left").withColumn("code", F.lit(None).cast("string"))
    if answer.blocks is not None:
        block = F.concat(F.lit("#### "), "name", F.lit(" ("), F.concat_ws(":", "file_path", "start_line"), F.lit(")\n\n```\n"), "code", F.lit("\n```\n"))
        code = answer.blocks.join(nodes.select("id", "name"), "id").groupBy("query_id").agg(_listed(F.struct("id", block.alias("text"))).alias("code"))
        whole = whole.drop("code").join(code, "query_id", "left")
    part = lambda title, c: F.coalesce(F.concat(F.lit(f"\n\n### {title}\n\n"), c), F.lit(""))
    return whole.select("query_id", F.concat(F.lit("## Answer\n\n**Query:** "), F.coalesce("query", F.lit("")), part("Entry points", "entries"), part("Related symbols", "others"), part("Code", "code")).alias("text"))


def tree(answer: Answer, nodes: DataFrame) -> DataFrame:
    """query_id, text: each entry with what it leads to, by kind, and the first of these with what they lead to; then what no tree shows, or how many.

    A symbol is drawn once. Each query's chosen symbols and the edges among them, which its limits bound, are one row.
    """
    symbol = F.struct((-F.col("score")).alias("o"), "id", "role", "kind", "name", "file_path", "start_line", "signature")
    chosen = _described(answer, nodes).groupBy("query_id").agg(F.array_sort(F.collect_list(symbol)).alias("nodes"))
    shown = answer.edges.filter(F.col("kind").isin(*SHOWN)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source", "kind", "target"))).alias("edges"))
    rows = chosen.join(shown, "query_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<source:string,kind:string,target:string>>")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [_tree([dict(n) if isinstance(n, dict) else n.asDict() for n in own], [tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in edges]) for own, edges in zip(rows["nodes"], rows["edges"], strict=True)]
            yield pd.DataFrame({"query_id": rows["query_id"], "text": texts})

    kind = dict(chosen.dtypes)["query_id"]
    return rows.select("query_id", "nodes", "edges").mapInPandas(run, f"query_id {kind}, text string")


def _tree(nodes: list[dict], edges: list[tuple]) -> str:
    by_id, out, lines, seen = {n["id"]: n for n in nodes}, {}, [], set()
    for source, kind, target in edges:
        out.setdefault(source, []).append((kind, target))
    place = lambda n: f"{n['kind']}: {n['name']} ({n['file_path']}" + (f":{int(n['start_line'])}" if n["start_line"] == n["start_line"] and n["start_line"] is not None else "") + ")"
    for entry in (n for n in nodes if n["role"] == "entry"):
        before, open_ = len(lines), [(entry, 0)]
        while open_:
            node, depth = open_.pop()
            if node["id"] in seen:
                continue
            seen.add(node["id"])
            pad, signature = "  " * depth, node["signature"] or ""
            lines.append(pad + place(node) + (f" - {signature if len(signature) <= SIGNATURE else signature[: SIGNATURE - 3] + '...'}" if signature else ""))
            kinds: dict[str, list[str]] = {}
            for kind, target in out.get(node["id"], []):
                kinds.setdefault(kind, []).append(by_id[target]["name"] if target in by_id else "unknown")
            for kind, names in kinds.items():
                if len(names) > NAMED:
                    lines.append(f"{pad}  ├── {kind}: {', '.join(names[:NAMED])} and {len(names) - NAMED} more")
                else:
                    lines += [f"{pad}  {'└──' if k == len(names) else '├──'} {kind} → {name}" for k, name in enumerate(names, 1)]
            if depth == 0:
                open_ += [(by_id[t], 1) for _, t in reversed(out.get(node["id"], [])[:NAMED]) if t in by_id]
        if len(lines) > before:
            lines.append("")
    rest = [n for n in nodes if n["id"] not in seen]
    if len(rest) > OTHERS:
        lines.append(f"... and {len(rest)} more related symbols")
    elif rest:
        lines += ["Other relevant symbols:", *("  " + place(n) for n in rest)]
    return "\n".join(lines).strip()
