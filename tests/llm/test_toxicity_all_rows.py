import zlib

import numpy as np

from symweave.llm import toxicity_cnn as T


def test_rows_beyond_the_sample_train_and_set_cuts(spark):
    known = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    # only rows that the sample leaves out say that vile is bad and what is French
    first = {r.i for r in spark.createDataFrame([(i,) for i in known], "i long").selectExpr("i", "xxhash64(i) h").orderBy("h", "i").limit(100).collect()}
    rng, rows, labels = np.random.default_rng(1), [], []
    for i in range(3000):
        toxic = int(i % 2 and i not in first)
        say = " ".join(f"w{x}" for x in rng.integers(0, 60, 12))
        rows.append((i, say + (" vile" if toxic else " kind"), "en" if i in first or i % 4 < 2 else "fr"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(docs, labels, 100)
    assert model.language.shape[1] == 2 and len(model.cuts) == 2
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    truth = dict(labels.collect())
    assert np.mean([got[i].predicted == truth[i] for i in got if got[i].held_out]) > 0.97


def test_cuts_of_cells_have_the_best_f1():
    rng = np.random.default_rng(2)
    for _ in range(50):
        z = rng.integers(-9, 9, 60)
        truth = z + rng.normal(0, 3, 60) > 1
        f1 = lambda cut: 2 * (truth & (z >= cut)).sum() / ((z >= cut).sum() + truth.sum())
        got = T.best_cut_of_cells(z, np.ones(60, np.int64), truth.astype(np.int64), 0.0)
        assert np.isclose(f1(got * T.CELLS), max(f1(c) for c in z))
