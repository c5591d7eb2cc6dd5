"""Periodic runs against a search over all periods, and the query against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.llm import periodic_runs as R

from .cases import ROWS, table


def plain_runs(words):
    """(start, length, period) of all runs: for every period all maximal stretches, those of a smaller period left out."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(texts):
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    most = 1 + max([w for t in texts for w in t], default=0)
    words = np.array([w for n, k in enumerate(order) for w in (*texts[k], most + n)], np.int64)
    found = {k: [] for k in order}
    starts = np.append(0, np.cumsum(sizes + 1))
    for (a, b), q in R.periodic_runs(words, sizes).items():
        n = int(np.searchsorted(starts, a, "right")) - 1
        found[order[n]].append((int(a - starts[n]), b - a, q))
    return [sorted(found[k]) for k in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 7)), max_size=5), min_size=1, max_size=3))
def test_all_runs_are_found(parts):
    texts = [[w for unit, times in own for w in unit * times] for own in parts]
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_runs_on_every_scale():
    draw = random.Random(3)
    texts = []
    for q in (*range(1, 40), 63, 64, 65, 100, 127, 128, 129, 255, 256, 257):
        unit = [draw.randrange(3 + q % 5) for _ in range(q)]
        texts.append([9] + (unit * 5)[: 4 * q + draw.randrange(-1, q)] + [8, 7])
        texts.append([draw.randrange(2) for _ in range(9)] + unit * 9)
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def plain(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = [hashlib.sha256(s.encode()).hexdigest() for s in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *sha)


def compare(rows, df):
    def key(r):
        return str(r)

    assert sorted(map(tuple, df.collect()), key=key) == sorted((plain(*r) for r in rows), key=key)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 6000").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 6000")
    compare(rows, R.digests(R.collapse(docs)))
    assert sum(plain(*r)[1] > 0 for r in rows) > len(rows) // 30


def test_odd_rows(spark):
    rows = [r for r in ROWS if len(r[1] or "") < 10000] + [(50, "a\x1cb " * 9, "en", "a"), (51, "x  y\n" * 40 + " z", "en", "a"), (52, "é " * 5, "en", "a")]
    compare([(r[0], r[1]) for r in rows], R.digests(R.collapse(table(spark, rows))))
    assert R.digests(R.collapse(table(spark, []))).count() == 0


def test_a_long_text_takes_time_in_proportion(spark):
    draw = random.Random(5)
    text = [draw.randrange(40000) for _ in range(200000)]
    text[50000:170000] = text[50000:90000] * 3
    text[180000:] = [1, 2] * 10000
    assert runs_of([text]) == [[(179999 if text[179999] == 2 else 180000, 20000 + (text[179999] == 2), 2)]]
    text[40000:200000] = text[:40000] * 4
    assert runs_of([text]) == [[(0, 200000, 40000)]]
