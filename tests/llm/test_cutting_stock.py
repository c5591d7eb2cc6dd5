"""Packing by column generation: plans on small histograms against all patterns, packed ids against the tokenizer."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symweave.llm import cutting_stock as C
from symweave.llm import pattern_packing as P

from .cases import ROWS, table

HISTOGRAMS = st.dictionaries(st.integers(1, 31), st.integers(1, 300), max_size=20)


def all_patterns(lengths, room):
    if not lengths:
        yield ()
        return
    for n in range(room // lengths[0] + 1):
        for rest in all_patterns(lengths[1:], room - n * lengths[0]):
            yield (n, *rest)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(2, 16), st.integers(1, 300), min_size=1, max_size=5))
def test_the_linear_program_is_optimal(histogram):
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[w] for w in lengths.tolist()], float)
    patterns, x, bound = C.column_generation(lengths, demand, 16, 1e-7, 0)
    assert np.allclose(sum(n * p for n, p in zip(x, patterns)), demand) and (x >= 0).all()
    value = sum(n * C.cost(int(p @ lengths), 16) for n, p in zip(x, patterns))
    assert bound <= value + 1e-6
    basis = np.array(patterns, float)
    prices = np.linalg.solve(basis, [C.cost(int(p @ lengths), 16) for p in patterns])
    if value > float(lengths @ demand) / 16 * (1 + 1e-6):  # else every packing costs as much
        for p in all_patterns(lengths.tolist(), 16):
            assert not sum(p) or prices @ p <= C.cost(int(np.dot(p, lengths)), 16) + 1e-6


@settings(max_examples=60, deadline=None)
@given(HISTOGRAMS)
def test_plans_pad_nothing_and_hold_each_item_once(histogram):
    slots, bounds, tail = C.plan(histogram, 32)
    cells = np.array([c for c, n in histogram.items() for _ in range(n)], np.int64)
    ranks = np.array([k for n in histogram.values() for k in range(n)], np.int64)
    if not len(cells):
        return
    item, within, size, sequence, offset = C.fragments(slots, bounds, tail, cells, ranks)
    held, of_item = defaultdict(list), defaultdict(list)
    for i, w, n, s, o in zip(item.tolist(), within.tolist(), size.tolist(), sequence.tolist(), offset.tolist()):
        held[s].append((o, n))
        of_item[i].append((w, n))
    for own, total in ((held.values(), None), (of_item.values(), True)):
        for parts in own:
            at = 0
            for o, n in sorted(parts):
                assert o == at and n > 0
                at += n
            assert total or at == 32 or at & (at - 1) == 0 and at < 32
    assert all(sum(n for _, n in of_item[i]) == c for i, c in enumerate(cells.tolist()))


def test_many_equal_sequences_with_a_gap_fill_each_other():
    slots, _, _ = C.plan({20: 10**9 + 7, 23: 10**8 + 1}, 32)
    assert len(slots) < 500
    cells, ranks = np.full(1000, 20), np.arange(5 * 10**8, 5 * 10**8 + 1000)
    assert len(C.fragments(slots, np.empty(0, np.int64), -1, cells, ranks)[0]) < 2600


def check(rows, got):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted(((d is None, d or 0), tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows)
    of_doc, held = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        of_doc[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == C.LENGTH or at & (at - 1) == 0 and at < C.LENGTH
    times = Counter(d for d, _ in rows)
    for (lacks, doc_id), ids in expected:
        doc = None if lacks else doc_id
        if times[doc] == 1:
            assert [i for _, own, _ in sorted(of_doc[doc]) for i in own] == ids
            assert {n for _, _, n in of_doc[doc]} == {len(ids)}
    assert sum(len(ids) for _, ids in expected) == sum(r.length for r in got)


def test_documents_are_packed_whole_and_without_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = C.pack(docs).collect()
    check(rows, got)
    assert sum(r.start > 0 and r.start % C.LENGTH != r.doc_tokens % C.LENGTH for r in got) < len(rows)


def test_odd_rows(spark):
    check([(r[0], r[1]) for r in ROWS], C.pack(table(spark)).collect())
    assert C.pack(table(spark, [])).count() == 0


def test_offsets_beyond_the_bound_of_a_broadcast(spark):
    cut = P.pieces(table(spark).repartition(3), public_tokenizers.path("byte_bpe_50k.json"), None).cache()
    joined = P.with_offsets(cut, most=0)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    kinds = [sorted((r.cell, r.task, r.place, r.before) for r in df.select("cell", "task", "place", "before").collect()) for df in (joined, P.with_offsets(cut))]
    assert kinds[0] == kinds[1]
    assert joined.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct(F.col("before") + F.col("place")).alias("d")).where("n != d").count() == 0


def test_batches_that_differ_are_counted(spark, monkeypatch):
    differing = spark.sparkContext.accumulator(0)
    wrong = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")  # another vocabulary's ranks
    texts = [(k, f"some words here and there {k}", "en", "a") for k in range(300)]
    df = P.pieces(table(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), wrong, differing=differing)
    right = P.pieces(table(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), None)
    assert sorted((r.doc_id, bytes(r.ids)) for r in df.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in right.collect())
    assert differing.value > 0
