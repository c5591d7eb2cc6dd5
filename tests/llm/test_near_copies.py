from itertools import combinations

import corpus_pipeline
import numpy as np

from symweave.llm import near_copies as N

NEAR = dict(corpus_pipeline.STAGES)["near_dedup"]
SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
            root = [root[i] if r == root[j] else r for r in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def changed(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"z{rng.integers(1 << 30)}"
    return out


def test_the_stage_drops_verified_near_copies(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(80):
        words = [f"w{x}" for x in rng.integers(0, 1 << 20, int(rng.integers(12, 600)))]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            rows.append((10 * k + j, " ".join(changed(rng, words, round(len(words) * j / 50)))))
    kept = {r.doc_id for r in NEAR(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == plain_kept(rows) and len(kept) < 250


def test_the_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = NEAR(spark, docs, sf_dir)
    assert got.schema == docs.schema and {r.doc_id for r in got.collect()} == plain_kept(rows)


def test_a_large_group_in_small_blocks_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(100)]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(changed(rng, words, 1))) for i in range(60)] + [(7, "another text under an id that repeats"), (None, "words without an id here now"), (None, " ".join(words))]
    got = N.drop_near_copies(spark.createDataFrame(rows, SCHEMA), block=8)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[0], rows[60], rows[61]], key=str)


def test_links_between_those_that_the_first_links_and_others_are_kept(spark):
    rng, rows = np.random.default_rng(3), []
    base = [f"w{i}" for i in range(120)]
    for k in range(40):  # a chain: each a few words further from the first
        base = base[:115] + [f"t{k}_{i}" for i in range(5)] if k % 8 == 0 else changed(rng, base, 1)
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join(f"v{x}" for x in rng.integers(0, 1 << 20, 50))) for k in range(20)]
    for block in (2, 5, 256):
        assert {r.doc_id for r in N.drop_near_copies(spark.createDataFrame(rows, SCHEMA), block=block).collect()} == plain_kept(rows)


def test_candidates_at_the_bound():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 1 << 63, (2, 180), np.uint64)
        b[:160] = a[:160]  # 160 of 200
        assert (N.bands(np.sort(a)) == N.bands(np.sort(b))).any()


def test_repeated_rows_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text), (3, text), (4, text + " more"), (None, text), (3, "something else altogether, under an id that repeats"), (None, None), (None, ""), (9, "one"), (8, "ONE"), (9, "one")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in N.drop_near_copies(docs).collect()), key=str)
    assert [r for r in got if r[0] is not None] == sorted([(3, text), rows[4], (8, "ONE")], key=str)
    assert len(got) == 4 and not [t for i, t in got if i is None][0]
    assert N.drop_near_copies(docs.limit(0)).count() == 0


def test_other_columns_decide_among_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (1, "same words", "a"), (2, "same words", "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in N.drop_near_copies(docs).collect()] == [(1, "same words", "a")]
