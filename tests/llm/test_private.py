import hashlib
import math
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from symweave.llm import pii_information as P

from .cases import ROWS, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


HARD = [
    "a@b.c@d.e x@y.zw-_q@r.st", "@a.b a@b a@b. a@b..c a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4 1.2.3", "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112", "+1 (375) 555-4393 +12 +1234567890123456 ++49 30 1234567",
    "😀é a.b@c.de ünï 10.0.0.1 " * 3, "x" * 50_000, "1" * 30_000, "1-" * 20_000, ("a." * 5_000) + "@" + ("b." * 5_000) + "c", "", "+1 375 555 4393 4111111111111111",
]


def test_base_spans_equal_pythons(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "i int, text string")
    got = {r.i: [(s["start"], s["kind"], s["end"]) for s in r.spans] for r in rows.select("i", P.base_spans(F.col("text")).alias("spans")).collect()}
    for i, text in enumerate(HARD):
        assert got[i] == [s[:3] for s in plain_spans(text)], text[:60]


def check(rows, docs):
    got = {r.doc_id: r for r in P.find_personal_data(docs).collect() if r.doc_id is not None}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        spans = plain_spans(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in PLAIN]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        assert spans or r.spans == ""
    return got


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], docs)


def test_odd_rows(spark):
    docs = table(spark)
    check([(r[0], r[1]) for r in ROWS], docs)
    assert P.find_personal_data(docs).count() == len(ROWS)
    assert P.find_personal_data(table(spark, [])).count() == 0
    clean = P.sanitise(docs)
    assert clean.schema == docs.schema
    by_id = {r.doc_id: r for r in clean.collect()}
    assert by_id[15].text == "Write to [EMAIL] or [IP], card [CARD], call [PHONE]." and by_id[15].n_chars == len(by_id[15].text)
    assert by_id[1].text is None and by_id[6].text == ROWS[5][1]


def apart(text, spans):
    """(start, piece) of what no span covers."""
    out, at = [], 0
    for s, _, e, _ in spans:
        if s >= at:
            out.append((at, text[at:s]))
        at = max(at, e)
    return [*out, (at, text[at:])]


def plain_disclosures(rows, support=P.SUPPORT, generalise=P.GENERALISE):
    """For each text its terms' shares, by counts over all rows."""
    n, spans = len(rows), {t: plain_spans(t) for _, t in rows}
    own = {t: {(k, re.sub("[^0-9]", "", t[s:e]) if k in ("card", "phone") else t[s:e].lower()) for s, _, e, k in spans[t]} for t in spans}
    words = lambda t: set(re.findall(r"\w{3,}", t.lower()))
    free = {t: words("\n".join(p for _, p in apart(t, spans[t]))) for t in spans if spans[t]}
    c_e, c_t, c_te, texts = Counter(), Counter(), Counter(), defaultdict(set)
    for _, t in rows:
        c_t.update(words(t))
        for e in own[t]:
            c_e[e] += 1
            texts[e].add(t)
            c_te.update((w, e) for w in free[t])
    shares = defaultdict(dict)
    for (w, e), k in c_te.items():
        if len(texts[e]) >= support and sum(w in free[t] for t in texts[e]) >= support and c_e[e] < n:
            share = math.log2(k * n / (c_t[w] * c_e[e])) / math.log2(n / c_e[e])
            if share >= generalise:
                for t in texts[e]:
                    if w in free[t]:
                        shares[t][w] = max(share, shares[t].get(w, 0))
    return shares


def check_terms(rows, got):
    """rows: doc_id, text; got: spans by doc_id. Returns how many terms there are."""
    shares, total = plain_disclosures(rows), 0
    for doc_id, text in rows:
        spans = plain_spans(text)
        terms = [(at + m.start(), 4, at + m.end(), "term") for at, piece in apart(text, spans) for m in re.finditer(r"\w{3,}", piece) if m[0].lower() in shares[text]]
        assert got[doc_id] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans + terms))
        total += len(terms)
    return total


def corpus():
    filler = ["the meeting was long and nobody spoke", "we ate bread and cheese in the garden", "rain fell on the old stone bridge", "a train left the station at noon"]
    rows = [(i, f"{filler[i % 4]} today, number {i}.") for i in range(40)]
    rows += [(100 + i, f"Zorblatt: {filler[i]} and then some more words, a long way off, before they wrote from z.blatt@mail.example for case {i}. Signed, zorblatt") for i in range(4)]
    rows += [(200 + i, f"{filler[i]} and the office wrote from o{i}@mail.example.") for i in range(4)]
    return rows


def test_terms_that_disclose_are_found_by_brute_force_counts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.find_personal_data(docs).collect()}
    assert check_terms(rows, got) >= 8
    for i, text in rows:
        places = [m.start() for m in re.finditer("(?i)zorblatt", text)]
        assert all(f"term:{at}:{at + 8}" in got[i].split(",") for at in places) and bool(places) == (100 <= i < 104)
    clean = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert all("zorblatt" not in clean[i].lower() and "@" not in clean[i] for i in range(100, 104))
    assert all(clean[i] == t for i, t in rows if i < 100)


def test_terms_in_documents(spark):
    """The documents at hand repeat no entity in different texts, so some get one: an address, and far from it a customer's code."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for k in range(0, 60, 3):
        doc_id, text = rows[k]
        rows[k] = (doc_id, f"qx{k % 4}code {text} write to person{k % 4}@host.example" + " or elsewhere" * (k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_term) for r in P.find_personal_data(docs).collect()}
    assert check_terms(rows, {i: s for i, (s, _) in got.items()}) == sum(n for _, n in got.values()) >= 20
    after = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert not any("code " in after[rows[k][0]] and f"qx{k % 4}code" in after[rows[k][0]] for k in range(0, 60, 3))
    assert all(after[i] == t for i, t in rows if not got[i][0])


@pytest.mark.skipif(not Path("/root/testdata/check_s").exists(), reason="needs the larger documents")
def test_terms_in_more_documents(spark):
    """Documents that do repeat entities in different texts, among others."""
    docs = spark.read.parquet("/root/testdata/check_s/documents.parquet").filter("text LIKE '%@%' OR doc_id % 40 = 0").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: r.spans for r in P.find_personal_data(docs).collect()}
    assert check_terms(rows, got) > 100


def test_a_list_of_addresses_takes_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"user{i}@mail{i % 7}.example.com +49 30 {1000000 + i}" for i in range(n))
        docs = spark.createDataFrame([(1, text), (2, text + " copy"), (3, "again " + text), (4, "nothing")], "doc_id long, text string")
        start = time.time()
        rows = P.sanitise(docs).collect()
        took = time.time() - start
        assert {len(re.findall(r"\[EMAIL\] \[PHONE\]", r.text)) for r in rows} == {0, n}
        return took

    seconds(10)
    assert seconds(20_000) < 40


def test_running_totals_in_blocks(spark):
    values = [[], [5], list(range(700)), [3] * 256, [9, 1] * 300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<int>")
    got = df.select("i", P.running(F.col("v"), lambda a, b: a + b).alias("sums"), P.running(F.col("v"), F.greatest).alias("most")).collect()
    for r in got:
        v = values[r.i]
        assert r.sums == [sum(v[:k]) for k in range(len(v))] and r.most == [max(v[:k], default=0) for k in range(len(v))]
