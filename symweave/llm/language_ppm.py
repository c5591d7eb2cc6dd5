"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of ORDER bytes and fewer counts what follows; a byte that a context has not seen is
coded by an escape (method C: as likely as the number of different followers) and the next shorter context, in the end
uniformly. The statistics are frozen after training, so the probability of a byte depends on its last ORDER bytes only
and all escapes can be worked out beforehand. The model holds what training has seen and no more: for each gram (a context and the byte
behind it) its whole code length in every language, and for each context its escapes. A text's code length is a sum of look-ups, those of the longest context first, and of
shorter ones only where the gram is new. The shortest code names the language.

Training is bounded by documented parameters, for each language: about PER_LANGUAGE documents and BYTES_PER_LANGUAGE bytes, chosen by hashed id, none of over LONGEST
bytes. There may be any number of languages: they are dealt into blocks of BLOCK in the order of their names, a block's trees are built in one task of
an executor, and texts are scored block after block, carrying the shortest code so far and what the others weigh against it. The driver holds one block at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import documents, held_out, small_batches, stored

ORDER, PER_LANGUAGE, BYTES_PER_LANGUAGE, LONGEST, BLOCK, LEAST_SCORE = 3, 1500, 8 << 20, 1 << 19, 32, 0.5
START, BITS = 256, 9  # the place before a text; bits of a symbol
CHUNK = 1 << 18
LETTER = regex.compile(r"\p{L}")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDER + 1 successive bytes (BITS bits each; START before the text) and how often they stand in the texts."""
    all_ = symbols(texts)
    code = np.zeros(max(len(all_) - ORDER, 0), np.int64)
    for k in range(ORDER + 1):
        code = code << BITS | all_[k : len(all_) - ORDER + k]
    return np.unique(code[all_[ORDER:] < START], return_counts=True)


def symbols(texts: list[bytes]) -> np.ndarray:
    """The texts' bytes one behind the other, ORDER times START before each."""
    pad = np.full(ORDER, START, np.int16)
    return np.concatenate([x for t in texts for x in (pad, np.frombuffer(t, np.uint8))]) if texts else np.empty(0, np.int16)


class Places:
    """Where different non-negative numbers stand in the order they were given: open addressing at a quarter of the slots or less."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.rows = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            empty = self.keys[slot] < 0
            first = np.unique(slot[empty], return_index=True)[1]
            won = np.flatnonzero(empty)[first]
            self.keys[slot[won]], self.rows[slot[won]] = keys[left[won]], left[won]
            lost = np.delete(np.arange(len(left)), won)
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places, -1 for numbers that are not there."""
        slot = self.slots(keys)
        at = self.keys[slot]
        found = self.rows[slot]
        open_ = np.flatnonzero((at != keys) & (at >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[open_]]
            found[open_] = self.rows[slot[open_]]
            open_ = open_[(at != keys[open_]) & (at >= 0)]
        return found


@dataclass
class Model:
    languages: list[str]
    contexts: list[tuple[Places, np.ndarray]]  # for each order from 0: contexts, and (context, language) bits of the escape; none where a language has not seen it
    followed: list[tuple[Places, np.ndarray]]  # for each order from 0: grams, and (gram, language) bits of the last byte, escapes included

    @classmethod
    def fit(cls, rows: list[tuple[str, int, int]]) -> Model:
        """rows: language, code of grams(), count."""
        languages = sorted({r[0] for r in rows})
        number = {la: k for k, la in enumerate(languages)}
        return cls.of_counts(languages, np.array([number[r[0]] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64))

    @classmethod
    def of_counts(cls, languages: list[str], of: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
        """of: each row's place in languages."""
        model = cls(languages, [], [])
        for order in range(ORDER + 1):
            part = gram & ((1 << BITS * (order + 1)) - 1)
            known, gram_row = np.unique(part, return_inverse=True)
            contexts, context_row = np.unique(known >> BITS, return_inverse=True)
            n = np.zeros((len(known), len(languages)))
            np.add.at(n, (gram_row, of), count)
            total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(total, context_row, n)
            np.add.at(kinds, context_row, n > 0)
            seen = kinds > 0
            escape = np.where(seen, np.log2(np.where(seen, total + kinds, 1)) - np.log2(np.where(seen, kinds, 1)), 0)
            shorter = model.lengths(known & ((1 << BITS * order) - 1), order - 1)
            own = np.log2(np.where(seen, total + kinds, 1))[context_row] - np.log2(np.where(n > 0, n, 1))
            model.contexts.append((Places(contexts), escape.astype(np.float32)))
            model.followed.append((Places(known), np.where(n > 0, own, escape[context_row] + shorter).astype(np.float32)))
        return model

    def lengths(self, codes: np.ndarray, order: int) -> np.ndarray:
        """(gram, language) bits of each gram's last byte behind the order bytes before it."""
        if order < 0:
            return np.full((len(codes), len(self.languages)), 8, np.float32)
        places, bits = self.followed[order]
        row = places.find(codes)
        new = np.flatnonzero(row < 0)
        found = bits[row]
        if len(new):
            found[new] = self.lengths(codes[new] & ((1 << BITS * order) - 1), order - 1)
            contexts, escapes = self.contexts[order]
            known = contexts.find(codes[new] >> BITS)
            found[new[known >= 0]] += escapes[known[known >= 0]]
        return found

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(text, language) code lengths. Short texts are taken together and long ones cut, CHUNK bytes at a time for four languages and fewer for more, so that memory is bounded."""
        out = np.zeros((len(texts), len(self.languages)))
        self.chunk = max(1, CHUNK * 4 // max(4, len(self.languages)))
        group, size = [], 0
        for i, text in enumerate([*texts, None]):
            if group and (text is None or size + len(text) > self.chunk):
                self._add(out, group, [texts[k] for k in group])
                group, size = [], 0
            group.append(i)
            size += len(text or b"")
        return out

    def _add(self, out: np.ndarray, which: list[int], texts: list[bytes]) -> None:
        all_, sizes = symbols(texts), [len(t) + ORDER for t in texts]
        own = np.repeat(np.array(which), sizes)
        for at in range(ORDER, len(all_), self.chunk):
            part = all_[at - ORDER : at + self.chunk]
            code = np.zeros(len(part) - ORDER, np.int64)
            for k in range(ORDER + 1):
                code <<= BITS
                code |= part[k : len(part) - ORDER + k]
            real = part[ORDER:] < START
            text = own[at : at + self.chunk][real]
            if len(text):
                first = np.flatnonzero(np.diff(text, prepend=-1))
                out[text[first]] += np.add.reduceat(self.lengths(code[real], ORDER), first, axis=0, dtype=np.float64)

    def judge(self, texts: list[str | None], before: list[tuple[float, str, float] | None]) -> list[tuple[float, str, float] | None]:
        """For each text the shortest code's bits, its language, and the sum of all languages' shares against it (tempered by the root of the text's length),
        other blocks' in before included; None for a text without letters. Ties go to before."""
        raw = [t.encode() if t and LETTER.search(t) else b"" for t in texts]
        found: list[tuple[float, str, float] | None] = []
        for text, bits, old in zip(raw, self.bits(raw), before, strict=True):
            root = max(len(text), 1) ** 0.5
            least = float(bits.min())
            new = least, self.languages[int(bits.argmin())], float(np.exp2(-(bits - least) / root).sum())
            if old:
                first, second = (old, new) if old[0] <= new[0] else (new, old)
                new = first[0], first[1], first[2] + second[2] * float(np.exp2(-(second[0] - first[0]) / root))
            found.append(new if text else None)
        return found


@dataclass
class Trained:
    """Models of blocks of languages, stored as rows (block, model)."""

    blocks: int
    table: DataFrame | None = None

    def model(self, block: int) -> Model:
        return pickle.loads(self.table.filter(F.col("block") == block).first().model)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE, block: int | None = None) -> Trained:
    """Models from rows that are not held out and have a text, of LONGEST bytes at most, and a lang.

    A row is taken if its hashed id falls within its language's share, which is such that about per_language rows and bytes_per_language bytes are. The driver
    gets the names of the languages.
    """
    block = block or BLOCK
    size = F.octet_length("text")
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (size <= LONGEST) & ~held_out())
    share = F.least(F.lit(1.0), per_language / F.count(F.lit(1)), bytes_per_language / F.greatest(F.sum(size), F.lit(1)))
    sizes = stored(usable.groupBy("lang").agg(share.alias("share")), "languages", keep=True)
    names = sorted(r.lang for r in sizes.select("lang").collect())
    if not names:
        return Trained(0)
    places = docs.sparkSession.createDataFrame([(la, k // block, k % block) for k, la in enumerate(names)], "lang string, block int, place int")
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                gram, n = grams([texts[i] for i in np.flatnonzero(langs == lang)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None

        def made() -> pa.RecordBatch:
            of, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            model = Model.of_counts(names[now * block : (now + 1) * block], of, gram, n.astype(float))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], ["block", "model"])

        for batch in batches:
            blocks, *own = (batch.column(k).to_numpy() for k in range(4))
            for b in np.unique(blocks):
                if now is not None and b != now:
                    yield made()
                    held = []
                now = int(b)
                held.append([x[blocks == b] for x in own])
        if held:
            yield made()

    texts = small_batches(usable.join(sizes, "lang").filter(chosen)).select("lang", F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    dealt = counts.join(places, "lang").select("block", F.col("place").cast("long").alias("place"), "gram", "n").repartition("block").sortWithinPartitions("block", "place", "gram")
    return Trained(-(-len(names) // block), stored(dealt.mapInArrow(fit, "block int, model binary"), "model", keep=True))


FOUND = "struct<bits:double,lang:string,share:double>"


def judged(docs: DataFrame, trained: Trained) -> tuple[DataFrame, str]:
    """docs with one more column (FOUND, null for texts without a letter), whose name is returned, too. Between blocks of languages the rows are stored."""
    name = "_found"
    while name in docs.columns:
        name += "_"
    rows, schema = small_batches(docs), StructType([*docs.schema.fields, *docs.sparkSession.createDataFrame([], f"`{name}` {FOUND}").schema.fields])
    if not trained.blocks:
        return docs.withColumn(name, F.lit(None).cast(FOUND)), name
    kind = pa.struct([("bits", pa.float64()), ("lang", pa.string()), ("share", pa.float64())])
    for block in range(trained.blocks):
        shared = docs.sparkSession.sparkContext.broadcast(trained.model(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=not block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = [None] * batch.num_rows if first else [r and tuple(r.values()) for r in batch.column(batch.num_columns - 1).to_pylist()]
                found = shared.value.judge(batch.column(batch.schema.get_field_index("text")).to_pylist(), before)
                state = pa.array([f and dict(zip(("bits", "lang", "share"), f, strict=True)) for f in found], kind)
                own = batch.columns if first else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, state], [*batch.schema.names[: len(own)], name])

        rows = rows.mapInArrow(run, schema)
        if block + 1 < trained.blocks:
            rows = stored(rows, "judged", keep=True)
    return rows, name


def identify(docs: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text).

    Null texts and those without a letter are `und` with score 0; ties go to the language first by name. A text of any length
    is scored whole. Repeated rows get equal results; a null doc_id is not held out. Other columns are ignored, and an
    empty table gives an empty result. Without languages everything is `und`.
    """
    rows, found = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")), trained)
    return rows.select("doc_id", "held_out", F.coalesce(f"{found}.lang", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col(f"{found}.share"), F.lit(0.0)).alias("score"))


def keep_identified(docs: DataFrame, trained: Trained, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without rows that are `und` or score less than least_score; all columns as they were.

    Null and empty texts and those without a letter go. Repeated rows stay or go together, whatever their doc_id; an empty table stays empty, and
    without languages every row goes.
    """
    rows, found = judged(docs, trained)
    return rows.filter(1 / F.col(f"{found}.share") >= least_score).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
