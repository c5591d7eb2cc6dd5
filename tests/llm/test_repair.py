"""Repair of conversations against a search over all edits."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.llm import conversation_repair as C

WELL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, part string, audit string, cost int"


def cheapest(rows, extra=4):
    """(cost, audit) of the best edits, from all edits whose roles may still become well-formed."""

    def better(states, key, option):
        if re.match(r"s?(ua)*u?\Z", key) and (key not in states or option < states[key]):
            states[key] = option
            return True
        return False

    states = {"": (0, "")}
    for k in range(len(rows) + 1):
        todo = list(states)
        while todo:
            roles = todo.pop()
            cost, audit = states[roles]
            todo += [roles + t for t in "ua" if len(roles) < len(rows) + extra and better(states, roles + t, (cost + 5, audit + "I"))]
        if k == len(rows):
            break
        initial, forced, cut = rows[k]
        after = {}
        for roles, (cost, audit) in states.items():
            better(after, roles, (cost + 2, audit + "D"))
            if not forced:
                better(after, roles + (initial or "?"), (cost + 5 * cut, audit + "K"))
                for t in "ua":
                    better(after, roles + t, (cost + 1 + 5 * cut, audit + "R"))
        states = after
    found = [v for roles, v in states.items() if WELL.match(roles)]
    return min(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u", "a", "s", "x", ""]), st.booleans(), st.booleans()), max_size=6))
def test_edits_are_the_cheapest_and_least(rows):
    ends = [q for q, e in enumerate(C.GRAPH.ends) if e]
    cost, audit, _ = C.edits(rows, ends)[0]
    assert (cost, audit) == cheapest(rows)
    roles, _, q = C.apply([(r[0] and r[0] + "-role", "") for r in rows], audit, 0)
    assert WELL.match("".join(r[0] for r in roles)) and q in ends


def test_the_stack_graph_takes_what_the_grammar_takes():
    for n in range(7):
        for word in (("usa"[k // 3**i % 3] for i in range(n)) for k in range(3**n)):
            at, word = [0], "".join(word)
            for t in word:
                at = [m for q in at for m in C.GRAPH.steps[q][t]]
            at = set(at)
            text = "".join(word)
            assert any(C.GRAPH.ends[q] for q in at) == bool(WELL.match(text)), text
    with pytest.raises(ValueError, match="left-recursively"):
        C.StackGraph((("L", ("u", "L")), ("L", ())))


def plain(turns):
    """The result of the operator, conversation by conversation; turns: conv_id, turn, role, text."""
    of, found = defaultdict(list), {}
    for conv, turn, role, text in turns:
        own = of[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn is not None, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in of.items():
        own.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        seen, needs, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            needs.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns_ = [t for k, t, *_ in own if k]
        cost, audit = cheapest(needs, 3) if len(needs) < 12 else C.edits(needs, [q for q, e in enumerate(C.GRAPH.ends) if e])[0][:2]
        lines, k = [], 0
        for letter in audit:
            _, _, role, text = ("", "", "", "") if letter == "I" else own[k]
            k += letter != "I"
            if letter in "RI":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
        found[conv] = {
            "gaps": max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0, **counts,
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(needs, needs[1:], strict=False)),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return found


def results(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_conversations_of_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(C.op11_conversation_repair(spark, sf_dir)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "No turn."), (1, None, None, None), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (1, 9, "tool", "Made."), (2, 0, "user", ""), (2, 1, "", "No role."),
        (None, 0, "user", "No conversation."), (None, None, "assistant", "None!"), (3, 0, "user", "long " * 60000 + "."), (3, 1, "assistant", "long " * 300000 + "."), (4, 5, "system", "Be kind."),
        (4, 6, "assistant", "So"), (4, 7, "system", "Ünï?"), (4, -2, "umpire", "A\x00b."),
    ]
    rows += [(100 + k, t, "user" if t % 2 else "assistant", f"Turn {t // 3}.") for k in range(40) for t in range(k % 7)]
    full = [(*r, "x", "y", 7) for r in rows]
    assert results(C.digests(C.repair(C.damaged(spark.createDataFrame(full, SCHEMA))))) == plain(rows)
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    assert results(C.digests(C.repair(C.damaged(spark.createDataFrame([(gone, 0, "user", "Gone.", "x", "y", 7)], SCHEMA))))) == {gone: empty}
    assert C.digests(C.repair(C.damaged(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 200)
    rows = [(7, t, ("user", "assistant", "system", "user")[(t * t) % 4], f"Row {t % 50 if t % 3 else t}" + "." * (t % 5 > 0)) for t in range(3000)]
    rows += [(8, 1, "user", "The same.")] * 2000 + [(9, t, "user" if t % 2 else "assistant", "Well said.") for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repaired = C.repair(C.damaged(df)).cache()
        repaired.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results(C.digests(repaired)) == plain(rows)
    lines = C.repaired_turns(repaired).where("conv_id = 7").orderBy("part", "chunk", "position").collect()
    assert WELL.match("".join(r.role[0] for r in lines)) and len({r.part for r in lines}) > 1
