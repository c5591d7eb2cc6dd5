"""Repair of conversations by generalised LR parsing of their roles.

GRAMMAR says which orders of role initials are well-formed: `(s?(ua)+)?`. Its LR automaton is built from the rules; a stack is a linked node (state, node
below), so stacks share what they have in common, and equal stack tops are one node however they were reached. As the list is left-recursive, a handful
of nodes closes the graph. Over a conversation, each node and row may keep, rerole, delete or insert at a weight. The sweep over
the rows runs from the end: what may follow a top is merged to its minimum by (cost, audit), and two audits of equal cost differ at a letter before either
ends, so a letter and a rank tell them apart and no audit is copied on the way.

Rows are dealt by range over (conv_id, turn, role, text), so that a conversation of any size falls into stretches. A stretch that may go on in
another partition is solved for every node that it may end at; the few such stretches of a conversation are then joined from its end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, documents, small_batches, stored

GRAMMAR = (("C", ()), ("C", ("P", "T")), ("P", ()), ("P", ("s",)), ("T", ("u", "a")), ("T", ("T", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}  # what rerole and insert may give
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Characters of text in one row of the result.
CHUNK = 1 << 20
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPAIRED = "conv_id long, part long, chunk long, audit string, roles array<string>, texts array<string>, " + ", ".join(f"{c} long" for c in NUMBERS)
FOUND = REPAIRED + ", summary string"
DIGESTS = "conv_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired_sha256 string"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(c, kinds[k]) for c, k in (f.split(" ") for f in ddl.split(", "))])


# the stack graph


class StackGraph:
    """All stack tops that a grammar's LR(0) automaton can reach, what each terminal makes of them, and those at which an input may end."""

    def __init__(self, rules=GRAMMAR, most: int = 50):
        self.rules = ((None, (rules[0][0],)), *rules)
        self.heads = {head for head, _ in rules}
        self.states: dict[frozenset, int] = {}
        self.gotos: list[dict[str, int]] = []
        self._state(frozenset({(0, 0)}))
        items = list(self.states)
        self.complete = [[r for r, dot in own if dot == len(self.rules[r][1])] for own in items]
        self.only = [len(own) == 1 and bool(done) for own, done in zip(items, self.complete, strict=True)]
        self.terminals = sorted({x for _, body in rules for x in body} - self.heads)
        nodes, at, self.steps = {(0, None): 0}, 0, []
        while at < len(nodes):
            if len(nodes) > most:
                raise ValueError("the grammar's stacks grow without end: write its lists left-recursively")
            node = list(nodes)[at]
            self.steps.append({t: [nodes.setdefault(n, len(nodes)) for n in self._shift(node, t)] for t in self.terminals})
            at += 1
        self.ends = [any(state == self.gotos[0].get(rules[0][0]) for state, _ in self._reduced(n)) for n in nodes]

    def _closure(self, items: frozenset) -> frozenset:
        found, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            ahead = self.rules[rule][1][dot : dot + 1]
            new = {(k, 0) for k, (head, _) in enumerate(self.rules) if ahead == (head,)} - found
            found |= new
            todo += new
        return frozenset(found)

    def _state(self, kernel: frozenset) -> int:
        items = self._closure(kernel)
        if items not in self.states:
            own = self.states[items] = len(self.gotos)
            self.gotos.append({})
            for x in sorted({self.rules[r][1][dot] for r, dot in items if dot < len(self.rules[r][1])}):
                self.gotos[own][x] = self._state(frozenset((r, dot + 1) for r, dot in items if self.rules[r][1][dot : dot + 1] == (x,)))
        return self.states[items]

    def _reduce(self, node: tuple, rule: int) -> tuple | None:
        head, body = self.rules[rule]
        for _ in body:
            node = node[1]
        return (self.gotos[node[0]][head], node) if head in self.gotos[node[0]] else None

    def _reduced(self, node: tuple) -> list[tuple]:
        """The node and all that reductions make of it."""
        found = [node]
        for n in found:
            found += [new for r in self.complete[n[0]] if r and (new := self._reduce(n, r)) and new not in found]
        return found

    def _shift(self, node: tuple, terminal: str) -> list[tuple]:
        found = [(self.gotos[n[0]][terminal], n) for n in self._reduced(node) if terminal in self.gotos[n[0]]]
        for k, n in enumerate(found):
            while self.only[n[0]] and self.complete[n[0]] != [0]:  # nothing else can be done at this top
                n = self._reduce(n, self.complete[n[0]][0])
            found[k] = n
        return list(dict.fromkeys(found))


GRAPH = StackGraph()


# edits


def edits(rows: list[tuple[str, bool, bool]], ends: list[int], graph: StackGraph = GRAPH) -> dict[int, tuple[int, str, list[str | None]]]:
    """For each node: cost, audit and the roles' initials (None where a row is kept or deleted) of the best edits from it to one of ends.

    rows: role initial, whether deletion is forced, whether keeping costs CUT more. Nodes that can't reach ends are left out.
    """
    nodes = range(len(graph.steps))
    into = [(q, t, n) for q in nodes for t in ROLES for n in graph.steps[q][t]]
    levels, chosen = [], []
    after: dict[int, tuple[int, int]] = {}
    for k in range(len(rows), -1, -1):
        best: dict[int, tuple] = {}

        def offer(q: int, cost: int, letter: str, rank: int, way: tuple, best=best) -> None:
            if q not in best or (cost, letter, rank) < best[q][:3]:
                best[q] = cost, letter, rank, way

        if k == len(rows):
            for q in ends:
                offer(q, 0, "", 0, None)
        else:
            initial, forced, cut = rows[k]
            more = CUT if cut else 0
            for q, (cost, rank) in after.items():
                offer(q, cost + DELETE, "D", rank, (q, None, 1))
            if not forced:
                for q in nodes:
                    for n in graph.steps[q].get(initial, ()):
                        if n in after:
                            offer(q, after[n][0] + KEEP + more, "K", after[n][1], (n, None, 1))
                for q, t, n in into:
                    if n in after:
                        offer(q, after[n][0] + REROLE + more, "R", after[n][1], (n, t, 1))
        level: dict[int, tuple[int, int]] = {}
        while open_ := [q for q in best if q not in level]:  # by rising cost: an insertion leads to a dearer node of the same level
            least = min(best[q][0] for q in open_)
            own = sorted((best[q][1:3], q) for q in open_ if best[q][0] == least)
            kinds = {key: r for r, key in enumerate(dict.fromkeys(key for key, _ in own))}
            level |= {q: (least, kinds[key]) for key, q in own}
            for q, t, n in into:
                if n in level and q not in level and level[n][0] == least:
                    offer(q, least + INSERT, "I", level[n][1], (n, t, 0))
        chosen.append({q: (best[q][1], best[q][3]) for q in level})
        levels, after = level, level
    found = {}
    for start, (cost, _) in levels.items():
        audit, roles, q, k = [], [], start, len(rows)
        while True:
            letter, way = chosen[k][q]
            if way is None:
                break
            audit.append(letter)
            q, role, taken = way
            roles.append(role)
            k -= taken
        found[start] = cost, "".join(audit), roles
    return found


def apply(rows: list[tuple[str, str]], audit: str, start: int, graph: StackGraph = GRAPH) -> tuple[list[str], list[str], int]:
    """Roles and texts after the edits that audit names, parsed from node start on, and the node at the end."""
    roles, texts, at, q = [], [], iter(rows), start
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter != "K":
            role = next(full for t, full in ROLES.items() if graph.steps[q][t])
        (q,) = graph.steps[q][role[:1]]
        roles.append(role)
        texts.append(text)
    return roles, texts, q


# stretches


def _stretch(own: list[dict]) -> tuple[list[tuple[str, str]], list[tuple[str, bool, bool]], dict]:
    """Rows (role, text) with copies apart, what edits needs of them, and figures that add up over stretches."""
    rows, needs, turns = [], [], []
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for r in own:
        if r["copies"] and r["turn"] is not None:
            turns.append(r["turn"])
        for copy in range(r["copies"]):
            fault = "blank" if r["blank"] else "duplicate" if r["later"] or copy else "truncated" if r["cut"] else None
            if fault:
                sums[fault] += 1
            rows.append((r["role"], r["text"]))
            needs.append((r["role"][:1], fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [r[0] for r in needs]
    sums["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    distinct = len(dict.fromkeys(turns))
    return rows, needs, sums | {"turns": [turns[0], turns[-1], distinct] if turns else None, "ends": [initials[0], initials[-1]] if rows else None}


def _joined(parts: list[dict]) -> dict:
    """Figures of a conversation from those of its stretches in order."""
    sums = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    ends = [p["ends"] for p in parts if p["ends"]]
    sums["illegal"] += sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(ends, ends[1:], strict=False))
    turns = [p["turns"] for p in parts if p["turns"]]
    distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
    return sums | {"gaps": turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0}


def _pieces(roles: list[str], texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        if k > start and size + len(text) + len(role) > CHUNK:
            yield start, k
            start, size = k, 0
        size += len(text) + len(role)
    yield start, len(roles)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation that begins and ends in this partition is repaired; of the first and the last, rows and best edits from node to node are handed on."""
    part = TaskContext.get().partitionId()
    accepting = [q for q, e in enumerate(GRAPH.ends) if e]

    def whole(conv_id: int | None, own: list[dict]) -> Iterator[dict]:
        rows, needs, sums = _stretch(own)
        cost, audit, _ = edits(needs, accepting)[0] if rows else (0, "", [])
        roles, texts, _ = apply(rows, audit, 0)
        if len(list(_pieces(roles, texts))) > 1:  # pieces are put in order again behind the shuffle
            yield from open_end(conv_id, own)
        else:
            yield {"conv_id": conv_id, "part": part, "chunk": 0, "roles": roles, "texts": texts, "audit": audit, "cost": cost} | {c: v for c, v in _joined([sums]).items() if c in NUMBERS}

    def open_end(conv_id: int | None, own: list[dict]) -> Iterator[dict]:
        rows, needs, sums = _stretch(own)
        between = [[(q, cost, audit) for q, (cost, audit, _) in edits(needs, [e]).items()] for e in range(len(GRAPH.steps))]
        yield {"conv_id": conv_id, "part": part, "chunk": -1, "summary": json.dumps(sums | {"between": between})}
        roles, texts = [r for r, _ in rows], [t for _, t in rows]
        for chunk, (a, b) in enumerate(_pieces(roles, texts)):
            yield {"conv_id": conv_id, "part": part, "chunk": chunk, "roles": roles[a:b], "texts": texts[a:b], "summary": "{}"}

    def turns() -> Iterator[dict]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                yield from batch.slice(k, 100).to_pylist()

    schema = arrow_schema(FOUND)
    first, held = True, None
    for conv_id, own in groupby(turns(), lambda r: r["conv_id"]):
        if held:
            yield from _batches(open_end(*held) if first else whole(*held), schema)
            first = False
        held = conv_id, list(own)
    if held:
        yield from _batches(open_end(*held), schema)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_pylist([row], schema)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs conversations from their stretches: rows by conv_id, summaries first, then texts, both in order."""
    schema = arrow_schema(REPAIRED)

    def repaired(conv_id: int | None, own: Iterator[dict]) -> Iterator[dict]:
        parts, audits, q, left, first = [], {}, 0, "", {}
        for r in own:
            if r["chunk"] < 0:
                parts.append((r["part"], json.loads(r["summary"])))
                continue
            if not audits:
                value = {e: (0, "", []) for e, ok in enumerate(GRAPH.ends) if ok}
                for _, p in reversed(parts):
                    new: dict[int, tuple] = {}
                    for e, ways in enumerate(p["between"]):
                        for start, cost, audit in ways:
                            if e in value:
                                option = cost + value[e][0], audit + value[e][1], [audit, *value[e][2]]
                                new[start] = min(new.get(start, option), option, key=lambda v: v[:2])
                    value = new
                audits = dict(zip((k for k, _ in parts), value[0][2], strict=True))
                first = {"cost": value[0][0], "audit": value[0][1]} | _joined([p for _, p in parts])
            if r["chunk"] == 0:
                left = audits[r["part"]]
            # letters of this chunk's rows, and insertions up to the next row
            n, k = len(r["roles"]), 0
            while k < len(left) and (n or left[k] == "I"):
                n -= left[k] != "I"
                k += 1
            roles, texts, q = apply(list(zip(r["roles"], r["texts"], strict=True)), left[:k], q)
            left = left[k:]
            yield {"conv_id": conv_id, "part": r["part"], "chunk": r["chunk"], "roles": roles, "texts": texts} | {c: v for c, v in first.items() if c == "audit" or c in NUMBERS}
            first = {}

    rows = (r for batch in batches for r in batch.to_pylist())
    for conv_id, own in groupby(rows, lambda r: r["conv_id"]):
        yield from _batches(repaired(conv_id, own), schema)


# the operator


def prepared(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, and what is wrong with each row: blank, later (role and text stand at an earlier turn), cut (truncated).

    Equal rows become one with their number before anything is dealt, and rows with copies 0 only hold their conversation.
    """
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))
    again = rows.groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn")).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("key").alias("_key"), "first")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key")), "left")
    bare = F.rtrim("text", F.lit(SPACES))
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return rows.select("conv_id", "turn", "role", "text", "copies", (bare == "").alias("blank"), later.alias("later"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def with_nothing_lacking(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (1); null roles and texts are one space."""
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows that a checksum of `conv_id:turn` leaves: dropped (copies 0, without content), emptied, without stops, repeated (copies 2), or of role user."""
    rows = with_nothing_lacking(turns)
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    gone = F.col("kind") == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, part, chunk, audit, roles, texts, gaps, blank, duplicate, truncated, illegal, cost: repaired conversations in pieces of some CHUNK characters.

    turns: as with_nothing_lacking gives them. A conversation's pieces stand in one partition, in order; audit and figures stand in its first piece alone. Turns go
    by turn (null first), role, text; repeated rows stay beside each other, and all but the first are duplicates. An empty role has no initial and can't be
    kept. Rows without conv_id are one conversation. A text of any length is one turn. Other columns are ignored; an empty table gives no rows.
    A conversation without rows (copies 0) gives one empty piece. The audits of a conversation that spans partitions pass through one task, its texts piece by piece.
    """
    order = ("conv_id", "turn", "role", "text")
    found = stored(small_batches(prepared(turns)).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_solve, FOUND), "stretches", keep=True)
    open_ = found.where("summary IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", F.col("chunk") >= 0, "part", "chunk")
    closed = found.where("summary IS NULL").drop("summary")
    return closed.union(open_.mapInArrow(_join, REPAIRED))


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, part, chunk, position (in the piece), role, text."""
    return repaired.select("conv_id", "part", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("position", "row")).select("conv_id", "part", "chunk", "position", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """A row for each conversation: its figures, its audit and the SHA-256 of its repaired `role:text` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(DIGESTS)
        rows = (r for batch in batches for r in batch.to_pylist())
        done: list[dict] = []
        for conv_id, own in groupby(rows, lambda r: r["conv_id"]):
            out, digest, begun = {}, hashlib.sha256(), False
            for r in own:
                out = out or {c: r[c] for c in ("audit", *NUMBERS)}
                for role, text in zip(r["roles"], r["texts"], strict=True):
                    digest.update(f"{chr(10) * begun}{role}:{text}".encode())
                    begun = True
            done.append({"conv_id": conv_id, "repaired_sha256": digest.hexdigest()} | out)
            if len(done) == 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema)

    return repaired.mapInArrow(run, DIGESTS)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(documents(spark, sf_dir, "conversations"))))
