import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symweave.llm import exact_dedup as E
from symweave.llm import simhash as S

from .cases import LONG, ROWS, table


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        own = groups[text or ""]
        keep = max((i for i in own if i is not None), default=None)
        out.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_equals_brute_force(spark):
    got = Counter(tuple(r) for r in E.exact_dedup(table(spark)).drop("n_chunks").collect())
    assert got == expected_groups([(r[0], r[1]) for r in ROWS])


def test_exact_dedup_of_nothing(spark):
    assert E.exact_dedup(table(spark, [])).count() == 0


def test_chunks_join_to_the_text_and_find_their_place_again(spark):
    shifted = "x" * 37 + LONG
    rows = spark.createDataFrame([(LONG,), (shifted,), ("a" * 30_000,), ("",)], "text string")
    got = [r[0] for r in rows.select(E.chunks(F.col("text"))).collect()]
    assert ["".join(c) for c in got] == [LONG, shifted, "a" * 30_000, ""]
    assert max(map(len, got[2])) <= E.MAX_CHARS
    varied = " ".join(hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 9] + "de"[i % 3 : i % 3 + 1] for i in range(9000))
    a, b = (set(r[0]) for r in spark.createDataFrame([(varied,), ("inserted " + varied,)], "text string").select(E.chunks(F.col("text"))).collect())
    assert len(a & b) >= 0.8 * len(a)


def test_a_clash_of_identifiers_is_found_and_widened(spark):
    weak = lambda chunk: F.length(chunk) % 2
    rows = [(i, f"text {i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert E.clashes(E.recipes(docs, weak, 10, 100)) and not E.clashes(E.recipes(docs, F.xxhash64, 10, 100))
    got = E.exact_dedup(docs, [weak, *E.IDENTIFIERS], 10, 100)
    assert Counter(tuple(r) for r in got.drop("n_chunks").collect()) == expected_groups(rows)
    try:
        E.exact_dedup(docs, [weak], 10, 100)
        raise AssertionError
    except ValueError:
        pass


def expected_kept(rows):
    """Of each text the row with the largest id, once."""
    best = {}
    for doc_id, text in rows:
        key = text or ""
        if key not in best or (doc_id is not None, doc_id or 0) > (best[key] is not None, best[key] or 0):
            best[key] = doc_id
    return Counter((i, t) for t, i in best.items())


def test_drop_copies_keeps_columns_and_every_text(spark):
    docs = table(spark)
    kept = E.drop_copies(docs)
    assert kept.schema == docs.schema
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == expected_kept([(r[0], r[1]) for r in ROWS])
    assert E.drop_copies(table(spark, [])).count() == 0


def test_ids_that_repeat_or_lack_lose_no_text(spark):
    rows = [(1, "alpha text one"), (2, "alpha text one"), (1, "a wholly different text"), (None, "alpha text one"), (1, "a wholly different text"), (None, "no id here"), (None, "no id here"), (3, None), (3, ""), (2, "a third text")]
    got = E.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == expected_kept(rows)


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def expected_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    return Counter((rows[i][0], f"{prints[i]:016x}", least[roots[i]]) for i in range(len(rows)))


def test_simhash_equals_brute_force(spark):
    got = Counter(tuple(r) for r in S.simhash_dedup(table(spark)).collect())
    assert got == expected_components([(r[0], r[1]) for r in ROWS])


def test_simhash_of_nothing(spark):
    assert S.simhash_dedup(table(spark, [])).count() == 0


def test_simhash_on_documents_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in S.simhash_dedup(docs).collect()) == expected_components(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 63), st.integers(0, 63), st.integers(0, 63)), min_size=1, max_size=150), st.integers(0, 4))
def test_bit_sliced_pairs(flips, radius):
    base = [0x0123456789ABCDEF, 0xFFFFFFFFFFFFFFFF, 0, 0x5555555555555555]
    fps = np.array([base[b] ^ (1 << i) ^ (1 << j) ^ (1 << k) for b, i, j, k in flips], np.uint64)
    got = sorted((int(a), int(b)) for i, j in S.linked_pairs(fps, radius) for a, b in zip(i, j))
    assert got == [(i, j) for i, j in combinations(range(len(fps)), 2) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius]


def test_hot_group_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    fps = sorted({int(0x0F0F << 20) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (400, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    links = S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=32)
    got = {r.node: r.root for r in S.components(links).collect()}
    roots = plain_components(fps)
    least = {r: min(fps[i] for i in range(len(fps)) if roots[i] == r) for r in set(roots)}
    assert {f: got.get(f, f) for f in fps} == {fps[i]: least[roots[i]] for i in range(len(fps))}
