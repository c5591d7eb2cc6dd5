"""SimHash near-deduplication with bit-sliced comparison.

Fingerprints are 64 majority bits over the XXH64 of a text's 3-word shingles. Two fingerprints link at RADIUS or fewer
differing bits. Equal fingerprints collapse first. The 64 bits fall into BANDS bands; fingerprints within the radius agree
on at least BANDS - RADIUS bands, so grouping by every choice of that many bands brings each linked pair together.
A group is compared bit-sliced: bit b of all its members stands in one plane of 64-bit words, and carry-save counters update
the distances of one member to 64 others with a few bitwise operations. A word of 64 is left as soon as all its
lanes exceed the radius. A group larger than BLOCK is dealt into blocks by hash and compared as pairs of blocks in
separate cells, so no task holds a whole hot group. Each cell returns a spanning forest of its links, not all pairs; the
alternation of large and small stars then joins the forests into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, scratch, small_batches, stored

SEED, SHINGLE, RADIUS, BANDS, BLOCK, WINDOW = 42, 3, 2, 5, 4096, 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# fingerprints


def fingerprint(text: str | bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words. Lower-cases A-Z only; words end at ASCII white space."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    set_bits = np.zeros(64, np.int64)
    for part in np.array_split(hashes, range(4096, len(hashes), 4096)):
        set_bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as signed long) for each row."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


# comparison within a cell


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane b holds bit b of members 64 w to 64 w + 63."""
    full = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def linked_pairs(fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), i < j, of all pairs within the radius, a block of queries at a time.

    A block starts as all words of 64 lanes against its queries; every 8 bits the words whose lanes all exceed the radius are left.
    """
    n, sliced = len(fps), planes(fps)
    words = sliced.shape[1]
    rows = max(1, min(n, 4096 // words))
    levels = (radius + 1).bit_length()
    for first in range(0, n, rows):
        members = np.arange(first, min(n, first + rows))
        start = first // 64  # earlier words hold only i >= j
        later = np.packbits((lane := np.arange(start * 64, words * 64))[None, :] > members[:, None], axis=1, bitorder="little").view("<u8")
        inside = np.packbits(lane < n, bitorder="little").view("<u8")
        own, word = np.indices(later.shape).reshape(2, -1)
        over = ~(later & inside).ravel()  # lanes that are no pair, or whose count has passed the counters
        counters = [np.zeros_like(over) for _ in range(levels)]
        for b in range(64):
            carry = sliced[b, start + word] ^ np.where(fps[members[own]] >> np.uint64(b) & np.uint64(1), ALL, np.uint64(0))
            for k in range(levels):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                left = np.flatnonzero(~(over | exceeds(counters, radius)))
                own, word, over, counters = own[left], word[left], over[left], [c[left] for c in counters]
                if not len(left):
                    break
        near = np.unpackbits((~(over | exceeds(counters, radius))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(near)
        yield members[own[which]], (start + word[which]) * 64 + bit


def exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than the radius, compared from the highest bit down."""
    larger, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            larger |= equal & counters[k]
            equal = equal & ~counters[k]
    return larger


def forest(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each member the index of its component's first member."""
    root = np.arange(len(fps))
    for i, j in linked_pairs(fps, radius):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by cell. Small cells share a window, as a link that crosses cells is a link all the same."""
    cells, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(part: np.ndarray) -> pa.RecordBatch:
        part = np.unique(part)
        root = forest(part)
        moved = np.flatnonzero(root != np.arange(len(part)))
        return pa.RecordBatch.from_arrays([pa.array(part[moved].view(np.int64)), pa.array(part[root[moved]].view(np.int64))], ["a", "b"])

    def windows(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal cells, fps
        ends = np.flatnonzero(np.diff(cells)) + 1
        if last:
            ends = np.append(ends, len(cells))
        at = 0
        while len(ends) and at < ends[-1]:
            k = np.searchsorted(ends, at + WINDOW, "right") - 1
            to = ends[k] if k >= 0 and ends[k] > at else ends[np.searchsorted(ends, at, "right")]
            yield links(fps[at:to])
            at = to
        cells, fps = cells[at:], fps[at:]

    for batch in batches:
        cells = np.concatenate([cells, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        yield from windows(False)
    yield from windows(True)


def links(fps: DataFrame, bands: int = BANDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """a, b: links between different fingerprints that connect all that are within the radius. fps: distinct values in column fp."""
    edges = [64 * i // bands for i in range(bands + 1)]
    keys = []
    for chosen in combinations(range(bands), bands - radius):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        keys.append(F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long")))
    banded = fps.select("fp", F.posexplode(F.array(*keys)).alias("band", "key"))
    sizes = banded.groupBy("band", "key").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / block))
    own = F.pmod(F.xxhash64("fp"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = banded.join(sizes, ["band", "key"]).withColumn("own", own).withColumn("other", other)
    cell = F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = cells.select(cell.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_cells, "a long, b long").distinct()


# components


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge: large and small stars in turn."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(lowest, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(pairs.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs (which needs doc_id and text).

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty texts and texts without
    words have fingerprint zero and link like any other. Null doc_ids take part but name a component only if it has no
    other (component_id is then null). Rows that repeat a doc_id each get a row. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        prints = stored(fingerprints(docs), "fingerprints", keep=True)
        distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
        rooted = stored(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        by_print = stored(rooted.join(named, "root").select("fp", "component_id"), "named", keep=True)
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))
