"""Periodic runs of words, by minimizers on several scales.

A run is a maximal stretch of words with smallest period q and length >= max(LEAST, TIMES * q). For scale K = 2^s a word's mark is the hash of the K words
from it on, built from those of scale K / 2. The marks that are least in some window of K marks are the minimizers. Within a run of period q, K / 2 < q <= K, all q
marks of a period differ, every window holds a least one, and a run is long enough for two of them: so the same minimizer comes
again after exactly q words, and nowhere between. Each minimizer is paired with the next of the same mark; pairs K / 2 < distance <= K apart seed an
extension to both sides, word by word, which verifies the run; stretches that an earlier seed of that distance covered are not extended again. Periods
up to SHORT are found by comparing each word with the one so many places on.

All texts of a batch are scanned together, the longest first, so that a scale is applied to those texts only that are long enough for it. Between texts stands a
word that occurs nowhere else.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import arrow_schema
from .shared import documents, small_batches

LEAST, TIMES, SHORT = 6, 4, 8
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def windowed(values: np.ndarray, width: int, least: np.ufunc, fill: int) -> np.ndarray:
    """least over each window of width values, in linear time: within blocks from the left and from the right."""
    n = len(values)
    whole = np.full(-(-n // width) * width, fill, values.dtype)
    whole[:n] = values
    blocks = whole.reshape(-1, width)
    left = least.accumulate(blocks, axis=1).ravel()
    right = least.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(right[: n - width + 1], left[width - 1 : n])


def minimizers(marks: np.ndarray, width: int) -> np.ndarray:
    """Where marks are that are least in some window of width marks."""
    lows = windowed(marks, width, np.minimum, np.iinfo(np.uint64).max)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), lows, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(windowed(padded, width, np.maximum, 0) == marks)


def agreeing(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from i and j on, to the right (step 1) or left (-1), in growing blocks; i < j."""
    n, width = 0, 32
    room = len(words) - j if step > 0 else i + 1
    while n < room:
        size = min(width, room - n)
        if step > 0:
            same = words[i + n : i + n + size] == words[j + n : j + n + size]
        else:
            same = (words[i - n - size + 1 : i - n + 1] == words[j - n - size + 1 : j - n + 1])[::-1]
        if not same.all():
            return n + int(same.argmin())
        n, width = n + size, width * 2
    return n


def periodic_runs(words: np.ndarray, sizes: np.ndarray) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of all runs. words: ids of texts of falling sizes, each closed with an id of its own."""
    found: dict[tuple[int, int], int] = {}
    bounds = np.append(0, np.cumsum(sizes + 1))

    def keep(start: int, end: int, period: int) -> None:
        if end - start >= max(LEAST, TIMES * period):
            found[start, end] = min(period, found.get((start, end), period))

    for period in range(1, SHORT + 1):
        own = words[: bounds[np.searchsorted(-sizes, -max(LEAST, TIMES * period), "right")]]
        if len(own) <= period:
            break
        same = np.concatenate([[False], own[period:] == own[:-period], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for start, end in edges[edges[:, 1] - edges[:, 0] >= max(LEAST, TIMES * period) - period].tolist():
            keep(start, end + period, period)
    marks, scale = mixed(words.astype(np.uint64), words.astype(np.uint64)), 1
    while True:
        scale *= 2
        own = words[: bounds[np.searchsorted(-sizes, -TIMES * (scale // 2 + 1), "right")]]
        if len(own) < 2 * scale:
            return found
        marks = mixed(marks[: len(own) - scale + 1], marks[scale // 2 : len(own) - scale // 2 + 1])
        if scale <= SHORT or len(marks) < scale:
            continue
        at = minimizers(marks, scale)
        order = np.argsort(marks[at], kind="stable")
        one, two = at[order[:-1]], at[order[1:]]
        seeds = (marks[one] == marks[two]) & (two - one > scale // 2) & (two - one <= scale)
        seeds &= np.searchsorted(bounds, one, "right") == np.searchsorted(bounds, two, "right")
        one, two = one[seeds], two[seeds]
        covered: dict[int, int] = defaultdict(int)
        for k in np.argsort(one, kind="stable").tolist():
            i, j = int(one[k]), int(two[k])
            if i < covered[j - i]:
                continue
            right, left = agreeing(own, i, j, 1), agreeing(own, i - 1, j - 1, -1) if i else 0
            covered[j - i] = i + right
            keep(i - left, j + right, j - i)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """words; for one id in ten by checksum, from a place on, a few of them again and again."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _scan(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[tuple[int, int, int]], str]]:
    ids, texts = batch.column(0).to_pylist(), [planted((t or b"").split(), d) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    number: dict[bytes, int] = {}
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    words = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    ends = np.cumsum(sizes + 1)
    for k, end in zip(order, ends.tolist(), strict=True):
        own = texts[k]
        words[end - 1 - len(own) : end - 1] = [number.setdefault(w, len(number)) for w in own]
    words[ends - 1] = len(number) + np.arange(len(ends))
    runs: dict[int, list] = defaultdict(list)
    for (start, end), period in periodic_runs(words, sizes).items():
        k = int(np.searchsorted(ends, start, "right"))
        runs[order[k]].append((start - int(ends[k] - sizes[k] - 1), end - start, period))
    for k, (doc_id, own) in enumerate(zip(ids, texts, strict=True)):
        if found := sorted(runs.get(k, ())):
            found.sort(key=lambda r: (r[0], r[2]))
            change = np.zeros(len(own) + 1, np.int64)
            for start, length, period in found:
                change[start + period] += 1
                change[start + length] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        yield doc_id, found, b" ".join(own).decode()


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start and length in words, period; by start, then period), collapsed (the words that no run repeats, joined by one space).

    A row for each row of docs (doc_id, text), repeated rows included. Null and empty texts have no words and no runs. A text of any length is scanned whole, in
    a batch of its own if it is long. Words end at ASCII white space. Where runs overlap, a word goes if any of them repeats it. Nothing is planted where doc_id is
    null. Other columns are ignored; an empty table gives no rows. Runs are verified word by word; a collision of 64-bit hashes could hide one, and make none up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("runs", kind), ("collapsed", pa.string())])
        for batch in batches:
            rows = [{"doc_id": d, "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], "collapsed": text} for d, found, text in _scan(batch)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, RUNS)


def digests(collapsed: DataFrame) -> DataFrame:
    """A row for each of collapsed: its runs' number, the run of the greatest exponent (ties: least start, then period), and digests of runs and kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(DIGESTS)
        for batch in batches:
            rows = []
            for doc_id, runs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best: tuple | None = None
                for r in runs:
                    own = r["start"], r["length"], r["period"]
                    if best is None or own[1] * best[2] > best[1] * own[2]:
                        best = own
                start, length, period = best or (None, None, None)
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                rows.append((doc_id, len(runs), start, length, period, 1000 * length // period if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return collapsed.mapInArrow(run, DIGESTS)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse(documents(spark, sf_dir)))
