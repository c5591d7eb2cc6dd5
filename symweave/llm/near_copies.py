"""Near copies by verified similarity: the pipeline's stage, whole where op9's query is bound to few bits.

Fingerprints as op9's (SimHash, at most RADIUS bits apart) bring a first part of the candidates together; the rest comes from minima of hash functions.
Two texts are near copies if their sets of WIDTH-word shingles have a Jaccard similarity of THRESHOLD or more. At 0.8, majority
fingerprints differ in some 10 of 64 bits, which no banding of fingerprints brings together at bearable cost; so further candidates come
from minima of PER_BAND * MINHASH_BANDS hash functions over the shingles, of which a pair at 0.8 shares a band with probability 0.9996. Bands with
the same members are compared once. Each pair that shares a band is compared by the whole sets of 64-bit shingle hashes, so no link is
an estimate. Texts are read a second time only where they share a band. Of a group larger than BLOCK each set is first compared with the group's least;
those it links are one component, and need no comparison with each other. The rest is dealt as blocks, which meet each other and those of the linked ones. So
where all are copies of one template each moves twice, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, small_batches, stored, text_key, without
from . import simhash
from .simhash import SEED, components, fingerprint

WIDTH, THRESHOLD, MINHASH_BANDS, PER_BAND = 5, 0.8, 20, 5
#: Members of a block, and shingles that a block holds on average at most.
BLOCK, SHINGLES = 256, 1 << 19
_draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, MINHASH_BANDS * PER_BAND), np.uint64)
FACTORS, TERMS = _draw[0] << np.uint64(1) | np.uint64(1), _draw[1]


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted different XXH64 of the text's shingles; a text of fewer words is one shingle, a text without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(hashes, range(1024, len(hashes), 1024)):
        mixed = part ^ part >> np.uint64(31)
        np.minimum(least, (mixed[:, None] * FACTORS + TERMS).min(axis=0), out=least)
    key = np.zeros(MINHASH_BANDS, np.uint64)
    for row in least.reshape(MINHASH_BANDS, PER_BAND).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text (as bytes) of each row; no other column."""
    text = F.coalesce("text", F.lit(""))
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text.cast("binary").alias("text"))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, set_key, n (different shingles), fp (the SimHash fingerprint), keys of the bands, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, fps, keys = [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), width)
                found.append(set_key(hashes))
                sizes.append(len(hashes))
                fps.append(fingerprint(text.as_py()))
                keys.append(bands(hashes))
            listed = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), listed], ["doc_id", "text_key", "set_key", "n", "fp", "keys"])

    return keyed(docs).mapInArrow(run, "doc_id long, text_key binary, set_key long, n long, fp long, keys array<long>")


def sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """set_key, hashes (8 bytes each) for rows set_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["set_key", "hashes"])

    return texts.select("set_key", "text").mapInArrow(run, "set_key long, hashes binary")


def similar(members: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """For each set the index of its component's first, where sets of a Jaccard similarity of the threshold or more link."""
    root, sizes = np.arange(len(members)), np.array([len(m) for m in members])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.unique(np.concatenate(members), return_inverse=True)[1]
    held = np.zeros(len(ids) and ids.max() + 1, np.int32)
    for i in range(len(members) - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        own = ids[starts[i] : starts[i + 1]]
        held[own] = 1
        shared = np.add.reduceat(held[ids[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1])
        held[own] = 0
        near = np.flatnonzero(shared >= threshold * (sizes[i] + sizes[i + 1 :] - shared)) + i + 1
        if len(near):
            joined = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return root


def drop_near_copies(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """docs with one document of each component of near copies, that of the smallest doc_id; all columns as they were.

    Rows are told apart by doc_id and text: a doc_id that repeats with another text is another document. Of rows that repeat both one
    stays; a row without doc_id stays only where its component has no doc_id. Null texts, empty ones and others without words are near copies of
    each other. An empty table stays empty.
    """
    with scratch(docs.sparkSession):
        rows = stored(sketches(docs, width), "sketches")
        roots = components(links(docs, rows, width, threshold, block)).withColumnRenamed("node", "set_key")
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
        rooted = rows.select("doc_id", "text_key", "set_key").join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
        rooted = stored(rooted, "rooted")
        kept = stored(rooted.groupBy("root").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "first"), "kept")
        together = rooted.join(kept, "root").select("doc_id", "text_key", (first == F.col("first")).alias("kept"))
        keys = stored(together.groupBy("doc_id", "text_key", "kept").count(), "keys")
        gone = stored(keys.filter("NOT kept").select("doc_id", "text_key"), "gone", keep=True)
        return without(docs, gone, stored(keys.filter("kept AND count > 1").select("doc_id", "text_key"), "repeated", keep=True))


def links(docs: DataFrame, rows: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """a, b: links between the set keys of near copies that connect all of them. rows: the stored sketches of docs."""
    minima = rows.select("set_key", "n", F.posexplode("keys").alias("band", "key"))
    worded = rows.filter(F.size("keys") > 0)
    prints = stored(components(simhash.links(worded.select("fp").distinct())), "prints")
    of_print = worded.join(prints.withColumnRenamed("node", "fp"), "fp", "left").select("set_key", "n", F.lit(MINHASH_BANDS).alias("band"), F.coalesce("root", "fp").alias("key"))
    banded = minima.union(of_print)
    members = F.sum(F.xxhash64("set_key").cast("decimal(20,0)")).alias("members")
    groups = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), F.min("set_key").alias("least"), F.max("set_key").alias("most"), members)
    alike = groups.filter("least < most").groupBy("rows", "shingles", "least", "most", "members").agg(F.min(F.struct("band", "key")).alias("first"))
    parts = F.ceil(F.greatest(F.col("rows") / block, F.col("shingles") / SHINGLES))
    chosen = stored(alike.select("first.band", "first.key", "least", parts.alias("parts")), "chosen")
    shared = stored(banded.join(chosen, ["band", "key"]).select("band", "key", "set_key", "least", "parts").distinct(), "shared")
    of_set = rows.join(shared.select("set_key").distinct(), "set_key", "left_semi").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    wanted = stored(of_set.select("set_key", F.col("first.doc_id").alias("_doc"), F.col("first.text_key").alias("_key")), "wanted")
    texts = keyed(docs).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")))
    hashed = stored(sets(texts, width), "sets")
    # large groups: each set against the least of its group, whose set goes to wherever the others are
    large = shared.filter("parts > 1")
    pairs = large.filter("set_key <> least").select("set_key", "least").distinct()
    known = pairs.join(hashed, "set_key").join(hashed.select(F.col("set_key").alias("least"), F.col("hashes").alias("other")), "least")
    first = stored(known.mapInArrow(_compared(threshold), "a long, b long"), "first")
    linked = first.select(F.col("a").alias("set_key"), F.col("b").alias("least"))
    marked = stored(large.filter("set_key <> least").join(linked.withColumn("linked", F.lit(True)), ["set_key", "least"], "left").select("band", "key", "set_key", F.coalesce("linked", F.lit(False)).alias("linked")), "marked")
    weighed = marked.join(hashed.select("set_key", (F.octet_length("hashes") / 8).alias("n")), "set_key").groupBy("band", "key")
    of = lambda is_: (F.count_if(is_), F.coalesce(F.sum(F.when(is_, F.col("n"))), F.lit(0)))
    cut = lambda rows_, shingles: F.ceil(F.greatest(rows_ / block, shingles / SHINGLES)).cast("long")
    blocks = weighed.agg(cut(*of(~F.col("linked"))).alias("rest_blocks"), cut(*of(F.col("linked"))).alias("linked_blocks")).filter("rest_blocks > 0")
    met = marked.join(blocks, ["band", "key"])
    among = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    own = F.pmod(F.xxhash64("set_key"), F.when(F.col("linked"), F.col("linked_blocks")).otherwise(F.col("rest_blocks")))
    cell = lambda kind, one, two: F.xxhash64("band", "key", F.lit(kind), one, two)
    with_rest = F.transform(among(F.col("rest_blocks")), lambda i: F.when(F.col("linked"), cell("linked", i, own)).otherwise(cell("rest", F.least(own, i), F.greatest(own, i))))
    with_linked = F.transform(among(F.col("linked_blocks")), lambda j: cell("linked", own, j))
    dealt = met.select(F.explode(F.when(F.col("linked"), with_rest).otherwise(F.concat(with_rest, with_linked))).alias("cell"), "set_key")
    small = shared.filter("parts <= 1").select(cell("whole", F.lit(0), F.lit(0)).alias("cell"), "set_key")
    cells = stored(small.union(dealt).distinct(), "cells")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def found() -> pa.RecordBatch:
            keys = sorted(held)
            root = similar([np.frombuffer(held[k], np.uint64) for k in keys], threshold) if len(keys) > 1 else np.arange(len(keys))
            pairs = [(keys[i], keys[r]) for i, r in enumerate(root) if i != r]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            for cell, key, hashes in zip(*(batch.column(k) for k in range(3)), strict=True):
                if (cell := cell.as_py()) != at:
                    yield found()
                    at, held = cell, {}
                held[key.as_py()] = hashes.as_py()
        yield found()

    together = cells.join(hashed, "set_key").select("cell", "set_key", "hashes").repartition("cell").sortWithinPartitions("cell")
    return together.mapInArrow(verify, "a long, b long").union(first).distinct()


def _compared(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows set_key, hashes, other with column least: the pairs of set_key and least whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            found = []
            for k in range(batch.num_rows):
                one, two = (np.frombuffer(at[c][k].as_py(), np.uint64) for c in ("hashes", "other"))
                both = len(np.intersect1d(one, two, assume_unique=True))
                found.append(both >= threshold * (len(one) + len(two) - both))
            own = batch.filter(pa.array(found, pa.bool_()))
            yield pa.RecordBatch.from_arrays([own.column(own.schema.get_field_index(c)) for c in ("set_key", "least")], ["a", "b"])

    return run
