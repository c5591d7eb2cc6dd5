"""Dependencies through groups, which stand for each of their users with each file that they hold."""

import random

import pytest

import symweave.operators.graph as G
from symweave.schema import Dependencies


def given(spark, direct, users, held):
    return Dependencies(spark.createDataFrame(direct, "path string, depends_on string"), spark.createDataFrame(users, "path string, `group` string"), spark.createDataFrame(held, "`group` string, depends_on string"))


def pairs(direct, users, held):
    return sorted({*direct, *((a, b) for a, g in users for h, b in held if g == h)})


def drawn(seed):
    r = random.Random(seed)
    name = lambda: f"{'tests/' if (n := r.randrange(24)) % 3 == 0 else ''}f{n}.ts"
    return [(name(), name()) for _ in range(14)], [(name(), f"g{r.randrange(4)}") for _ in range(8)], [(f"g{r.randrange(4)}", name()) for _ in range(8)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("depth", [1, 2, 5])
def test_tests_are_found_through_groups(spark, seed, depth):
    own = drawn(seed)
    steps = [(a, b) for a, b in pairs(*own) if not b.startswith("tests/")]
    expected = {(f, f) for p in pairs(*own) for f in p if f.startswith("tests/")}
    for t in {a for a, _ in steps if a.startswith("tests/")}:
        level = {t}
        for _ in range(depth):
            level = {b for a, b in steps if a in level}
            expected |= {(b, t) for b in level}
    changed = spark.createDataFrame([(f,) for p in pairs(*own) for f in p], "path string")
    got = [tuple(r) for r in G.affected_through(given(spark, *own), changed, depth).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_what_groups_stand_for_is_not_stored(spark, monkeypatch):
    users, held = [(f"tests/s{i}.ts", "g") for i in range(60)], [("g", f"c{i}.ts") for i in range(60)]
    rows, stored = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name, *a, **k: (lambda t: rows.append((name, t.count())) or t)(stored(df, name, *a, **k)))
    changed = spark.createDataFrame([(f"c{i}.ts",) for i in range(60)], "path string")
    assert G.affected_through(given(spark, [], users, held), changed).count() == 3600
    assert max(n for _, n in rows) <= 120, rows
    users, held = [(f"s{i}.ts", "g") for i in range(60)], [("g", f"c{i}.ts") for i in range(60)]
    rows.clear()
    found = G.cycles(given(spark, [(f"c{i}.ts", f"s{i}.ts") for i in range(59)], users, held)).collect()
    assert {tuple(r) for r in found} == {(f"{k}{i}.ts", "c0.ts", 118) for k in "cs" for i in range(59)}
    assert max(n for _, n in rows) <= 240, rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_cycles_through_groups(spark, seed):
    own = drawn(seed)
    steps = [p for p in pairs(*own) if p[0] != p[1]]
    above = {f: set() for p in steps for f in p}
    while True:
        grown = {f: above[f] | {b for a, b in steps if a == f or a in above[f]} for f in above}
        if grown == above:
            break
        above = grown
    expected = {(f, min(mates), len(mates)) for f in above if f in above[f] for mates in [{g for g in above[f] if f in above[g]}]}
    assert {tuple(r) for r in G.cycles(given(spark, *own)).collect()} == expected
    assert {tuple(r) for r in G.cycles(spark.createDataFrame(pairs(*own), "path string, depends_on string")).collect()} == expected
