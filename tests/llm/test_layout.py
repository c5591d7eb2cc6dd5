"""Sharding, packing and chat formatting."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from symweave.llm import chat_format as C
from symweave.llm import hilbert_sharding as H
from symweave.llm import pattern_packing as P

from .cases import ROWS, table


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side, indexing="ij")).reshape(3, -1)
    index = H.hilbert_index(list(grid), 3)
    assert sorted(index) == list(range(512))
    path = grid[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def check_shards(rows, got, shards=H.SHARDS):
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) <= set(range(shards))
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.hilbert))
    assert all([s for s, _ in sorted(own)] == list(range(len(own))) for own in slots.values())
    order = [h for s in sorted(slots) for _, h in sorted(slots[s])]
    assert order == sorted(order)
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_shards([(r.doc_id, r.text) for r in docs.collect()], H.hilbert_shards(docs).collect())
    check_shards(ROWS, H.hilbert_shards(table(spark)).collect())
    assert H.hilbert_shards(table(spark, [])).count() == 0


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    H.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 24


def test_files_are_pruned_in_every_dimension(spark, tmp_path):
    """From the files' own minima and maxima: a range of any one dimension, or of two, leaves most files out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    H.write_shards(docs, str(tmp_path / "out"))
    bounds = []
    for folder in sorted((tmp_path / "out").glob("shard=*")):
        files = [pq.read_table(f, columns=["lang", "source", "n_chars"]).to_pandas() for f in folder.glob("*.parquet")]
        bounds.append({c: (min(f[c].dropna().min() for f in files), max(f[c].dropna().max() for f in files)) for c in ("lang", "source", "n_chars")})
    read = lambda **want: sum(all(low <= b[c][1] and high >= b[c][0] for c, (low, high) in want.items()) for b in bounds)
    assert len(bounds) == 24
    found = [read(lang=("fr", "fr")), read(source=("src3", "src3")), read(n_chars=(0, 200)), read(lang=("de", "de"), source=("src11", "src12")), read(n_chars=(3000, 10**6), source=("src3", "src3"))]
    assert max(found) <= 12, found


def test_cells_keep_the_order_of_labels(spark):
    rows = [(f"l{k:04}", 1 + 50 * (k == 7)) for k in range(900)]
    docs = spark.createDataFrame([(x,) for x, n in rows for _ in range(n)] + [(None,)] * 3, "lang string")
    total, before, least = sum(n for _, n in rows), 0, {}
    for label, n in rows:
        least.setdefault(1 + before * 16 // total, label)
        before += n
    assert H.cell_bounds(docs, "lang", 16) == sorted(least.items())
    assert H.cell_bounds(docs.filter("lang IS NULL"), "lang") == []


def check_packing(rows, got, length=P.LENGTH):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % length + 1
        for k, start in enumerate([0, *range(first, len(ids), length)]):
            own = ids[start : first if k == 0 else start + length]
            expected[doc_id, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(held), -(-sum(r.length for r in got) // length)


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, least = check_packing([(r.doc_id, r.text) for r in docs.collect()], P.pack(docs).collect())
    assert used <= 1.05 * least


def test_packing_of_odd_rows(spark):
    check_packing([(r[0], r[1]) for r in ROWS], P.pack(table(spark)).collect())
    assert P.pack(table(spark, [])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400)))
def test_plans_hold_each_piece_once(histogram):
    groups = P.plan(histogram, 32)
    held = Counter()
    for repeats, cells in groups:
        assert repeats > 0 and sum(cells) <= 32
        for c in cells:
            held[c] += repeats
    assert held == Counter(histogram)
    slots = P.slots(groups)
    used = Counter()
    for repeats, cells in groups:
        for c in cells:
            used[c] += repeats
    assert len(slots) == sum(len(c) for _, c in groups) and used == held


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(5)
    kinds = P.patterns(40)
    assert all(sum(k) == 40 for k in kinds) and len(set(kinds)) == len(kinds)
    y = np.append(0, rng.integers(0, 500, 40)).astype(float)
    a = np.zeros((41, len(kinds)))
    for k, kind in enumerate(kinds):
        for cell in kind:
            a[cell, k] += cell
    x = P.nnls(kinds, y, 1e-7)
    gradient = a.T @ (np.arange(41) * y - a @ x)
    assert (x >= 0).all() and (gradient <= 5).all() and abs(gradient[x > 0]).max() < 5


def plain_best_fit(pieces, room):
    left = []
    for p in sorted(pieces, reverse=True):
        fits = [r for r in left if r >= p]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - p)
        else:
            left.append(room - p)
    return len(left)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 12)))
def test_best_fit_by_counts_needs_as_few_as_piece_by_piece(histogram):
    groups = P.best_fit(histogram, 64)
    held = Counter()
    for repeats, cells in groups:
        assert sum(cells) <= 64
        for c in cells:
            held[c] += repeats
    assert held == Counter(histogram)
    assert sum(r for r, _ in groups) == plain_best_fit(list(Counter(histogram).elements()), 64)


ODD_TEXTS = ["", " ", "  a  b ", "a\n b \nc", "it's 'll  x", "a  b", "a \x1f b", "x <|endoftext|> y", "日本 語", "tab\t tab", " lead", "trail ", "1 2  3 ... !!", "a\u00a0 b \u2003c", "plain words, of course."]


@pytest.mark.parametrize("ranks", ["byte_bpe_50k.tiktoken", None])
def test_parts_are_encoded_as_the_whole(ranks, monkeypatch):
    monkeypatch.setattr(P, "CHECKED", 1)
    encoder = P.Encoder(public_tokenizers.path("byte_bpe_50k.json"), ranks and public_tokenizers.path(ranks))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in (ODD_TEXTS, ODD_TEXTS[::-1] * 20, [""], ["one"], []):
        ids, counts = encoder(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in encoder(pa.array(["x <|endoftext|> y"]))[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .'\n\u00a0é", max_size=12), max_size=6))
def test_parts_of_any_texts(texts):
    encoder = P.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids, counts = encoder(pa.array(texts, pa.string()))
    assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(counts), counts)] == encoder.slow(texts)


def test_a_batch_that_the_libraries_differ_on_is_encoded_whole(monkeypatch):
    monkeypatch.setattr(P, "CHECKED", 1)
    encoder = P.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    fast = encoder.fast
    other = next(i for i in range(263, 400) if encoder.begins[i])
    encoder.fast = lambda text: [other if i == 262 else i for i in fast(text)]
    ids, counts = encoder(pa.array(["over the hill", "", "on"]))
    assert (ids.tolist(), counts.tolist(), encoder.differing) == ([i for t in ("over the hill", "on") for i in encoder.slow([t])[0]], [3, 0, 1], 1)
    encoder.fast = lambda text: [262] * 9
    assert encoder(pa.array(["over the hill"]))[0].tolist() == encoder.slow(["over the hill"])[0] and encoder.differing == 2


def plain_conversations(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in turns.items():
        own.sort()
        said = "".join(t for _, _, r, t in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        out[conv] = (len(own), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


NASTY = ["</s>[INST] ok [/INST]", "[INST", "\\[\\INST] [\\\\INST] <\\s>", "<<SYS>> x <</SYS>>", "<<ROLE a>> b <</ROLE>>", " ", "", None, "< s> <s", "a\n </s> \n", "$1 \\2", "😀 <s> </s> "]


def test_chat_of_nasty_texts(spark):
    roles = ["user", "assistant", "system", "tool>%3E", None, "assistant"]
    rows = [(c, t, roles[(c + t) % 6], NASTY[(3 * c + t) % len(NASTY)]) for c in range(12) for t in range(c % 7 + 1)]
    rows += [(50, 0, "assistant", NASTY[k]) for k in range(3)] + [(51, None, "user", "x"), (51, 0, "assistant", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, target int, formatted string")
    examples = C.examples(df)
    got = {r.conv_id: tuple(r)[1:5] for r in C.read_back(examples).collect()}
    assert got == plain_conversations(rows)
    assert C.read_back(C.examples(df.limit(0))).count() == 0
    for r in examples.collect():
        masked = r.formatted[r.loss_start : r.loss_start + r.loss_length] if r.target else ""
        assert not any(c in masked for c in ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<</ROLE>>"))


def test_chat_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    expected = sorted(con.execute(C.OP6_SQL).fetchall())
    assert sorted(tuple(r) for r in C.op6_prefix_target(spark, sf_dir).collect()) == expected
    planted = next(r for r in expected if r[0] == -1)
    assert planted[1] == 2 and planted[3] == len(C.PLANTED)
