from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from symweave.llm import language_ppm as L
from symweave.llm import registry
from symweave.llm.pii_information import find_personal_data

from .cases import ROWS, table
from .test_dedup import expected_groups
from .test_layout import check_packing
from .test_near_copies import plain_kept
from .test_private import plain_spans


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "personal_data", "packing"]
    language, exact, near, private, packing = (f for _, f in corpus_pipeline.STAGES)
    one = language(spark, docs, sf_dir).cache()
    known = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, L.train(docs)).collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, (lang, s) in known.items() if lang != "und" and s >= 0.5}
    assert one.count() > 0.95 * docs.count()
    two = exact(spark, one, sf_dir).cache()
    assert {r.doc_id for r in two.collect()} == {i for i, _, _, kept, _ in expected_groups([(r.doc_id, r.text) for r in one.collect()]) if kept}
    three = near(spark, two, sf_dir).cache()
    assert {r.doc_id for r in three.collect()} == plain_kept([(r.doc_id, r.text) for r in two.collect()])
    four = private(spark, three, sf_dir).cache()
    before = {r.doc_id: r.text for r in three.collect()}
    assert four.count() == three.count() and four.columns == docs.columns
    with_terms = {r.doc_id for r in find_personal_data(three).filter("n_term > 0").collect()}
    for r in four.collect():
        spans = plain_spans(before[r.doc_id])
        assert r.n_chars == len(r.text)
        if not spans:
            assert r.text == before[r.doc_id]
        elif r.doc_id not in with_terms:
            text, at = "", 0
            for s, _, e, kind in spans:
                if s >= at:
                    text += before[r.doc_id][at:s] + f"[{kind.upper()}]"
                at = max(at, e)
            assert r.text == text + before[r.doc_id][at:]
    rows = [(r.doc_id, r.text) for r in four.collect()]
    check_packing(rows, packing(spark, four, sf_dir).collect())
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(rows, whole)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_nothing_and_clashing_columns(spark, sf_dir, stage):
    name, run = stage
    assert run(spark, table(spark, []), sf_dir).count() == 0
    docs = table(spark)
    got = run(spark, docs, sf_dir)
    rows = Counter((r.doc_id, r.text) for r in got.collect()) if name != "packing" else None
    before = Counter((i, t) for i, t, *_ in ROWS)
    if name == "packing":
        assert Counter(r.doc_id for r in got.filter("piece = 0").collect()) == Counter(i for i, *_ in ROWS)
        return
    assert got.schema == docs.schema
    if name == "language":
        assert not rows - before and not {1, 2, 3, 12} & {i for i, _ in rows} and rows[10, ROWS[9][1]] in (0, 2)
    if name == "exact_dedup":
        assert set(rows.values()) == {1} and {t or "" for _, t in rows} == {t or "" for _, t in before}
    if name == "near_dedup":
        assert rows == Counter([(4, "one"), (5, "one two"), (6, ROWS[5][1]), (8, ROWS[7][1]), (1, None), (11, ROWS[11][1]), (None, "no id, but text"), (12, ROWS[14][1]), (15, ROWS[17][1])])
    if name == "personal_data":
        assert {i: t for i, t in rows if i != 15} == {i: t for i, t in before if i != 15} and sum(rows.values()) == len(ROWS)


def test_ids_that_repeat_or_lack_lose_no_text(spark, tmp_path):
    """Through all stages: no text goes that no other text stands for."""
    rng = np.random.default_rng(4)
    vocabulary = {"en": "the of and to in that was his with for are this from they", "de": "der die und nicht von das mit sich des auf für ist im dem"}
    prose = lambda la, n: " ".join(rng.choice(vocabulary[la].split()) + str(rng.choice(list("abcdef"))) * int(rng.integers(0, 2)) for _ in range(n))
    texts = [prose(la, 60) for la in ("en", "de") for _ in range(60)]
    rows = [(i % 50, t, "en" if i < 60 else "de") for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en"), (None, prose("en", 50), "en"), rows[5], rows[5], (1, texts[5] + " end", "en")]
    rows.append((None, rows[-4][1], "en"))
    docs = spark.createDataFrame([(i, t, la, "s", len(t)) for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        left = Counter(r.text for r in docs.collect())
        if name != "language":
            assert max(left.values()) == 1, name
        assert len(set(texts) - set(left)) <= (name == "near_dedup" or name == "personal_data"), name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.filter("piece = 0").count() == docs.count()


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
