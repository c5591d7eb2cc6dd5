import numpy as np
import corpus_pipeline

from symweave.llm import near_copies as N
from symweave.llm.simhash import RADIUS, fingerprint

NEAR = dict(corpus_pipeline.STAGES)["near_dedup"]


def test_fingerprints_bring_together_what_no_minima_do(spark):
    """Near copies whose words, said often, make equal fingerprints, and whose minima all differ."""
    rng, said = np.random.default_rng(7), " ".join(f"p{i}" for i in range(97))
    for _ in range(40_000):
        tails = [" ".join(f"{c}{x}" for x in rng.integers(0, 1 << 20, 12)) for c in "ab"]
        one, two = (" ".join([said] * 40 + [t]) for t in tails)
        sets = [N.shingle_hashes(" ".join([said, said, t]).encode()) for t in tails]
        if not (N.bands(sets[0]) == N.bands(sets[1])).any():
            break
    hashes = [N.shingle_hashes(t.encode()) for t in (one, two)]
    both = len(np.intersect1d(*hashes))
    assert both >= N.THRESHOLD * (len(hashes[0]) + len(hashes[1]) - both)
    assert not (N.bands(hashes[0]) == N.bands(hashes[1])).any() and (fingerprint(one) ^ fingerprint(two)).bit_count() <= RADIUS
    docs = spark.createDataFrame([(1, one), (2, two), (3, "something else altogether")], "doc_id long, text string")
    assert {r.doc_id for r in NEAR(spark, docs, "").collect()} == {1, 3}
