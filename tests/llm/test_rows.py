"""Operators that judge each row by itself, against plain versions."""

import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from symweave.llm import language_ppm as L
from symweave.llm import line_quality as Q
from symweave.llm import sentencepiece_backend as B
from symweave.llm import toxicity_cnn as T

from .cases import LONG, ROWS, table

SPACE = "[^\x20\x09-\x0d]+"


def plain_quality(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


ENDS, CLOSING, MARKS = ".!?…。！？؟", "\"'”’»)]", "!?#*$%&|<>"


def plain_verdict(line):
    """The rule that a line fails, from its words one by one."""
    bare = line.strip(" \t\n\x0b\x0c\r")
    words, low = bare.split(), bare.lower()
    hits, at = 0, 0
    while at < len(low):
        own = next((p for p in Q.NOTICES if low.startswith(p, at) and not (at and (low[at - 1].isalnum() or low[at - 1] == "_"))), None)
        hits += own is not None
        at += len(own) if own else 1
    if hits and 25 * hits >= len(words):
        return "boilerplate"
    apart = sum(w in "|»›•·" for w in bare) + sum(w in (">", "/") for w in words)
    if 3 * apart >= len(words):
        return "navigation"
    runs, before = 0, ""
    for c in bare + " ":
        if c not in MARKS:
            runs += len(before) >= 2
        before = before + c if c in MARKS else ""
    if 2 * runs >= len(words):
        return "punctuation"
    stem = bare.rstrip(CLOSING)
    return "keep" if len(words) >= 8 or stem and stem[-1] in ENDS else "punctuation"


def plain_kept(text):
    """Verdicts of the lines with words, and whether the document stays."""
    text = text or ""
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    verdicts = [plain_verdict(x) for x in lines]
    chars = lambda some: sum(len(w) for x in some for w in re.findall(SPACE, x))
    left = chars(x for x, v in zip(lines, verdicts) if v == "keep")
    return Counter(verdicts), not plain_quality(text)[-1] and 2 * left >= chars([text])


def check_quality(texts, got):
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(text)
        verdicts, kept = plain_kept(text)
        assert (r.n_bad_punctuation, r.n_bad_navigation, r.n_bad_boilerplate, r.kept) == (*(verdicts[v] for v in ("punctuation", "navigation", "boilerplate")), kept), text


def test_quality_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = Q.clean_lines(docs).collect()
    assert len(got) == len(texts)
    check_quality(texts, got)
    assert 0 < sum(not r.kept for r in got if not r.base_failed) and sum(r.n_bad_boilerplate for r in got) and sum(r.n_bad_navigation for r in got)


def test_prose_is_not_taken_for_notices_or_navigation():
    long = " ".join(f"word{i}" for i in range(1500)) + " and a cookie with the tea. " + " ".join(f"word{i}" for i in range(1500, 3000)) + "."
    assert Q.clean(long)["kept"] and Q.clean(long.replace("cookie", "loaf"))["kept"]
    assert Q.line_verdict("Prices and/or rates in km/h and m/s vary by 3/4.") == "keep"
    assert [Q.line_verdict(x) for x in ("Alle Rechte vorbehalten.", "Tous droits réservés - mentions légales.", "Todos los derechos reservados.", "We use cookies on this page.", "Home / Shop / About")] == ["boilerplate"] * 4 + ["navigation"]
    for line in (long, "Home > Shop > News", "He said: \"No!\"", "a|b", "!!", "© 2020", "x / y / z", "BUY!! IT!! NOW", "»Ja.«", "one two three four five six seven eight"):
        assert Q.line_verdict(line) == plain_verdict(line), line


def test_quality_of_odd_rows(spark):
    got = Q.clean_lines(table(spark)).collect()
    assert len(got) == len(ROWS)
    assert Counter((r.doc_id, *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r.base_failed) for r in got) == Counter((i, *plain_quality(t)) for i, t, *_ in ROWS)
    assert Q.clean_lines(table(spark, [])).count() == 0
    assert plain_quality("a b c a b c\x1fd e \x85f")[:5] == tuple(Q.clean("a b c a b c\x1fd e \x85f")[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_lines_are_judged_one_by_one():
    prose = "A sentence that says something at some length, and then goes on to end in a full stop."
    verdict = Q.line_verdict
    assert [verdict(x) for x in (prose, "Home | Shop | About | Contact", "All rights reserved.", "Read more", "Short but whole.", "BUY!! IT!! NOW!! OR!!")] == ["keep", "navigation", "boilerplate", "punctuation", "keep", "punctuation"]
    words = " ".join(f"word{i}" for i in range(60))
    mixed = Q.clean("\n".join([prose, words + ".", "Home | Shop", ""]))
    assert mixed["kept"] and mixed["cleaned"] == "\n".join([prose, words + ".", ""]) and mixed["n_bad_navigation"] == 1
    assert not Q.clean("\n".join([f"a{i} | b{i} | c{i} | d{i}" for i in range(30)] + [prose]))["kept"]


def plain_bits(texts, order=L.ORDER):
    """Code lengths by escaping context by context, from counts in dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    seen = set()
    for t in texts:
        padded = [None] * order + list(t)
        seen.update(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[k][tuple(padded[i - k : i]), padded[i]] += 1

    def bits(text):
        total, padded = 0.0, [None] * order + list(text)
        for i in range(order, len(padded)):
            p = 1.0
            for k in range(order, -1, -1):
                context = tuple(padded[i - k : i])
                n = {s: c for (x, s), c in counts[k].items() if x == context}
                if not n:
                    continue
                if padded[i] in n:
                    p *= n[padded[i]] / (sum(n.values()) + len(n))
                    break
                p *= len(n) / (sum(n.values()) + len(n))
            else:
                p /= 256
            total -= np.log2(p)
        return total

    return bits


def test_code_lengths_equal_escapes_worked_out_one_by_one():
    of = {"a": [b"abracadabra abra", b"banana bandana"], "b": ["œuf ça va".encode(), b"le lac"]}
    rows = [(lang, int(g), int(n)) for lang, texts in of.items() for g, n in zip(*L.grams(texts))]
    model = L.Model.fit(rows)
    probes = [b"", b"abra", "ça banane œ\x00\xff".encode("latin-1", "ignore"), b"zzz bra", b"le lac abracadabra"]
    got = model.bits(probes)
    for k, lang in enumerate(model.languages):
        plain = plain_bits(of[lang])
        assert np.allclose(got[:, k], [plain(p) for p in probes], rtol=1e-5)


def test_chunks_of_a_long_text_make_no_difference(monkeypatch):
    model = L.Model.fit([("a", int(g), int(n)) for g, n in zip(*L.grams([LONG.encode()[:4000]]))])
    whole = model.bits([LONG.encode()])
    monkeypatch.setattr(L, "CHUNK", 997)
    assert np.allclose(model.bits([LONG.encode()]), whole)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs, L.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert {r.held_out for r in got} == {True} and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_any_number_of_languages_in_blocks(spark):
    draw = np.random.default_rng(2)
    words = {f"l{k:02}": ["".join(chr(97 + (k * 5 + c) % 26) for c in draw.integers(0, 9, 6)) for _ in range(30)] for k in range(11)}
    rows = [(k, " ".join(draw.choice(words[la], 30)), la, 1) for k, la in enumerate(sorted(words) * 20)] + [(999, "123", "l01", 1), (1000, None, "l02", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _found int")
    one = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(docs, L.train(docs)).collect()}
    many = L.train(docs, block=2)
    assert many.blocks == 6 and {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(docs, many).collect()} == one
    assert {la for la, _ in one.values()} == {*words, "und"} and sum(one[k][0] == la for k, _, la, _ in rows[:-2]) > 215
    kept = L.keep_identified(docs, many)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {k for k, (_, score) in one.items() if score >= L.LEAST_SCORE}


def test_language_of_odd_rows(spark):
    docs = table(spark)
    model = L.train(docs)
    got = L.identify(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (1, 2, 3, 12)] == ["und"] * 4 and by_id[8] == "en"
    kept = L.keep_identified(docs, model)
    assert kept.schema == docs.schema and not {1, 2, 3, 12} & {r.doc_id for r in kept.collect()}
    empty = table(spark, [])
    assert L.identify(empty, L.train(empty)).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.train(empty)).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = T.score(docs, T.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    score, truth = np.array([r.score for r in got]), np.array([r.toxic for r in got], bool)
    rank = np.argsort(np.argsort(score)) + 1
    auc = (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())
    assert auc >= 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(3, None)], "doc_id long, toxic int")
    docs, empty = table(spark), table(spark, [])
    got = T.score(docs, T.train(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert T.score(empty, T.train(empty, labels)).count() == 0
    untrained = T.score(docs, T.train(docs, labels.limit(0))).collect()
    assert len(untrained) == len(ROWS) and not any(r.predicted for r in untrained)


def test_the_network_learns_its_rows():
    rng = np.random.default_rng(1)
    words = [T.hashed(w)[0] for w in ("bad", *(f"w{i}" for i in range(200)))]
    docs = [np.array([words[i] for i in rng.integers(1, 200, 30)] + [words[0]] * (k % 2), np.uint64) for k in range(240)]
    toxic = np.arange(240) % 2
    model = T.fit(docs, toxic.astype(np.float32), ["en"] * 240)
    assert ((model.scores(docs) >= T.THRESHOLD) == toxic.astype(bool)).mean() > 0.97


def small_network(seed=4):
    rng = np.random.default_rng(seed)
    model = T.fit([], np.zeros(0, np.float32), [])
    n = 1 << T.BUCKET_BITS
    model.tables = tuple(rng.normal(0, 1, (n, T.SIZE)) for _ in range(2))
    model.filters = [rng.normal(0, 1, f.shape) for f in model.filters]
    model.biases = [rng.normal(0, 1, b.shape) for b in model.biases]
    model.out, model.offset = rng.normal(0, 1, model.out.shape), 0.3
    docs = [rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (1, 2, 7, 0, 40)]
    return model, docs, np.array([0, 1, 1, 0, 1.0])


def plain_output(model, words):
    """The network's output, window by window."""
    mask = (1 << T.BUCKET_BITS) - 1
    e = [model.tables[0][int(w) & mask] + model.tables[1][int(w) >> 32 & mask] for w in words] + [np.zeros(T.SIZE)] * T.PAD
    z, at = model.offset, 0
    for width, filters, bias in zip(T.WIDTHS, model.filters, model.biases):
        for f in range(T.FILTERS):
            best = max((sum(float(e[i + j] @ filters[j][:, f]) for j in range(width)) + bias[f] for i in range(len(words))), default=0.0)
            z += max(best, 0.0) * model.out[at]
            at += 1
    return z


def test_outputs_equal_a_plain_forward_pass():
    model, docs, _ = small_network()
    assert np.allclose(model.outputs(docs)[0], [plain_output(model, d) for d in docs])


def test_gradients_equal_differences_of_the_loss():
    model, docs, toxic = small_network()
    docs, toxic = docs[:3] + docs[4:], toxic[[0, 1, 2, 4]]
    loss = lambda: T.loss_and_gradients(model, docs, toxic)[0]
    before, gradients, by_offset, (one, two, by_row) = T.loss_and_gradients(model, docs, toxic)
    z = np.array([plain_output(model, d) for d in docs])
    assert np.isclose(before, np.mean(np.log1p(np.exp(z)) - toxic * z))
    tables = [np.zeros_like(t) for t in model.tables]
    for table, bucket in zip(tables, (one, two)):
        np.add.at(table, bucket, by_row)
    rng, h = np.random.default_rng(0), 1e-6
    used = np.unique(one)
    for values, gradient, rows in [*((p, g, None) for p, g in zip([*model.filters, *model.biases, model.out], gradients)), *((t, g, u) for t, g, u in zip(model.tables, tables, (used, np.unique(two))))]:
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in values.shape)
            at = at if rows is None else (int(rng.choice(rows)), *at[1:])
            kept = values[at]
            values[at] = kept + h
            up = loss()
            values[at] = kept - h
            down = loss()
            values[at] = kept
            assert np.isclose((up - down) / (2 * h), gradient[at], rtol=1e-3, atol=1e-6)
    model.offset += h
    up = loss()
    model.offset -= 2 * h
    assert np.isclose((up - loss()) / (2 * h), by_offset, rtol=1e-3)


def test_cuts_of_each_language_have_the_best_f1():
    rng = np.random.default_rng(2)
    for _ in range(50):
        z = np.round(rng.normal(0, 1, 40), 1)
        truth = z + rng.normal(0, 0.7, 40) > 0.4
        f1 = lambda cut: 2 * (truth & (z >= cut)).sum() / max(1, (z >= cut).sum() + truth.sum())
        best = max(f1(c) for c in z)
        assert f1(T.best_cut(z, truth, 0.0)) >= best - 0.06
    words = {la: [T.hashed(f"{la}{i}")[0] for i in range(60)] for la in ("en", "de")}
    bad = T.hashed("bad")[0]
    docs, toxic, langs = [], [], []
    for k in range(800):
        la = ("en", "de")[k % 2]
        docs.append(np.array([words[la][i] for i in rng.integers(0, 60, 20)] + [bad] * (k % 4 < 2), np.uint64))
        toxic.append(float(k % 4 < 2))
        langs.append(la)
    model = T.fit(docs, np.array(toxic, np.float32), langs)
    z, spoken = model.outputs(docs)
    assert [("de", "en")[i] for i in spoken] == langs
    assert np.allclose((model.scores(docs) >= T.THRESHOLD), z >= model.cuts[spoken])


def test_training_words_are_bounded(spark):
    rows = [(i, f"w{i} " * 100, "en") for i in range(30)] + [(1, "again " * 100, "de")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    seen = []
    kept = T.fit
    T.fit = lambda docs, *rest: seen.append(list(map(len, docs))) or kept(docs, *rest)
    try:
        for sample, words in ((8000, 10**6), (8000, 550), (4, 10**6)):
            T.train(docs, labels, sample, words)
    finally:
        T.fit = kept
    known = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert seen[0] == [100] * len(known) and len(seen[1]) in (3, 4, 5) and set(seen[1] + seen[2]) == {100} and len(seen[2]) <= 4


def test_a_long_training_text_does_not_end_training(spark):
    rows = [(i, (f"w{i} " * 20) + ("vile scum " if i % 2 else "kind friend ") * 4, "en") for i in range(200)]
    longest = min((i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: spark.range(1).selectExpr(f"xxhash64({i}L)").first()[0])
    rows[longest] = (longest, "endless " * 9000, "en")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score(docs, T.train(docs, labels, 8000, 4000)).collect()}
    bad, good = [got[i] for i in range(1, 200, 2) if i != longest], [got[i] for i in range(0, 200, 2) if i != longest]
    assert np.mean(bad) > np.mean(good) + 0.2


@pytest.fixture(scope="module")
def backend():
    return B.Backend(public_tokenizers.path("piece_bpe_32k.model"))


def test_sentencepiece_parity_and_round_trip(spark, sf_dir, backend):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    other = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in B.encode(docs).collect():
        ids = other.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.parity, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True, True)


def test_sentencepiece_on_odd_texts(spark, backend):
    odd = ["", " ", "  a  b ", "\n\n x\t y", "日本語のテキスト", "a▁b ▁▁c", "<s></s><0x0A><unk>", "😀\x00é" * 50, "x" * 5000, "   ", "aaaaaaa bbbbbbbb"]
    assert backend.encode_batch(odd) == backend.other.encode(odd)
    for texts in (odd, odd * 3 + ["plain words", "plain words too"], ["plain"], []):
        ids, counts, parity = backend.encode(pa.array(texts, pa.string()))
        assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(counts), counts)] == backend.other.encode(texts) and parity.all()
    assert backend.decode_batch(backend.encode_batch(odd)) == [t.replace("▁", " ") for t in odd]
    assert B.encode(table(spark)).count() == len(ROWS) and B.encode(table(spark, [])).count() == 0


def test_ids_that_differ_are_told(backend, monkeypatch):
    other = backend.other

    class Odd:
        def encode(self, texts, num_threads=1):
            return [[i + (i == 310 + 0 * len(t)) for i in ids] for t, ids in zip(texts, other.encode(texts))]

    texts = ["the house", "a tree stood there", " odd  the"]
    wrong = [310 in ids for ids in other.encode(texts)]
    monkeypatch.setattr(backend, "other", Odd())
    assert backend.encode(pa.array(texts))[2].tolist() == [not w for w in wrong]


def message(*fields):
    """A protobuf message of (number, value): integers, floats, bytes."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_models_have_parity(sf_dir, squeeze, fallback, tmp_path):
    """A model put together here from the documents' letters and syllables, with drawn scores, in both libraries."""
    rng = np.random.default_rng(8)
    texts = [t or "" for t in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id LIMIT 60").df()["text"]]
    words = sorted({"▁" + w for t in texts for w in t.split()})
    syllables = sorted({w[i:j] for w in words for i in range(len(w)) for j in range(i + 2, min(i + 5, len(w) + 1))})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)] * fallback
    letters = sorted(set("".join(words)) - set("ßz"))
    pieces += [(c, float(-9 - rng.random()), 1) for c in letters] + [(syllables[i], float(-3 - 5 * rng.random()), 1) for i in sorted(rng.choice(len(syllables), 600, replace=False))]
    own = [(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces]
    trainer = message((3, 1), (35, int(fallback)), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))
    normalizer = message((1, b"identity"), (3, 1), (4, int(squeeze)), (5, 1))
    path = tmp_path / "unigram.model"
    path.write_bytes(message(*own, (2, trainer), (3, normalizer)))
    backend = B.Backend(str(path))
    assert backend.spec.kind == "unigram" and backend.spec.squeeze == squeeze and backend.spec.byte_fallback == fallback
    probes = [*texts, "", "  two  spaces ", "z ß zz", "mañana ßz 日本"]
    ids, counts, parity = backend.encode(pa.array(probes, pa.string()))
    assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(counts), counts)] == backend.other.encode(probes)
    assert parity.all()


def test_unigram_models_are_built_too():
    pieces = [("<unk>", 0.0, B.UNKNOWN), ("▁", -2.0, 1), ("▁he", -3.0, 1), ("llo", -3.5, 1), ("l", -5.0, 1), ("o", -5.0, 1), ("h", -6.0, 1), ("e", -6.0, 1)]
    tokenizer = B.build(B.Spec(pieces, "unigram", False, b"", True, True))
    assert tokenizer.encode("  hello  hello ", add_special_tokens=False).tokens == ["▁he", "llo", "▁he", "llo"]
