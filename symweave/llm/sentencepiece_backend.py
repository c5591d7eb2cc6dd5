"""SentencePiece encoding and decoding through the tokenizers library.

The model's protobuf is parsed here (pieces, scores, kinds, trainer and normaliser settings), and the pipeline is rebuilt from it: the
normaliser's compiled character map and white-space rules, the metaspace mark, a Unigram model with the pieces' scores (or, for a
model of kind BPE, merges ordered by them), and byte fallback. Batches are encoded by the library's threads.

Where no piece holds a mark behind another character (checked), the different parts between single spaces of some MB of texts are encoded once; other texts are
encoded as a whole. The ids of every text are compared with what the sentencepiece library gives for the whole of it. Decoding runs the rebuilt decoder over the
whole id list of each text; what it gives is compared with the sentencepiece library's decoding and with the text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .parts import encode_by_parts, interleaved, joined
from .shared import documents, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
THREADS = 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: str = "unigram"
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Spec:
        spec = cls()
        for number, value in wire(data):
            if number == 1:
                own = dict(wire(value))
                spec.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(wire(value))
                spec.kind = {1: "unigram", 2: "bpe"}[own.get(3, 1)]
                spec.byte_fallback = bool(own.get(35, 0))
            elif number == 3:
                own = dict(wire(value))
                spec.charsmap, spec.dummy_prefix, spec.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        return spec


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
    found = [(-s, piece, k) for piece, s in score.items() for k in range(1, len(piece)) if piece[:k] in score and piece[k:] in score]
    return [(piece[:k], piece[k:]) for _, piece, k in sorted(found)]


def build(spec: Spec):
    """The tokenizers library's Tokenizer for a model."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    unknown = next(i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN)
    if spec.kind == "bpe":
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec.pieces), unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unknown, spec.byte_fallback)
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Replace(" ", MARK)] + ([normalizers.Prepend(MARK)] if spec.dummy_prefix else [])
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in spec.pieces):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tokenizer.decoder = decoder(spec)
    return tokenizer


def decoder(spec: Spec, joined_first: bool = False):
    """The library's decoder for a model. joined_first: marks turn into spaces in the whole text, those that bytes make up, too."""
    from tokenizers import decoders

    # Metaspace reads characters where Replace searches each token by a regular expression; as it takes no prefix away, they give the same
    marks, join = [decoders.Metaspace(MARK, "never")], [decoders.ByteFallback(), decoders.Fuse()]
    return decoders.Sequence([*(join + marks if joined_first else marks + join), *[decoders.Strip(" ", 1, 0)] * spec.dummy_prefix])


class Backend:
    """Encodes and decodes as the model at path does, and verifies that."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path, "rb") as file:
            self.spec = Spec.parse(file.read())
        self.tokenizer = build(self.spec)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        #: whether a text's parts may be encoded one by one
        self.parted = self.tokenizer.pre_tokenizer is not None and self.spec.dummy_prefix and not self.spec.squeeze and not self.spec.charsmap
        #: the same decoder with its parts joined first, for ids without the byte that a mark begins with: marks made of bytes stay marks
        self.joining = Tokenizer(self.tokenizer.model)
        self.joining.decoder = decoder(self.spec, joined_first=True)
        self.mark_byte = self.tokenizer.token_to_id(f"<0x{MARK.encode()[0]:02X}>")
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.spec.pieces])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        held = [self.mark_byte in x for x in ids]
        exact = iter(self.tokenizer.decode_batch([x for x, h in zip(ids, held, strict=True) if h], skip_special_tokens=False))
        others = iter(self.joining.decode_batch([x for x, h in zip(ids, held, strict=True) if not h], skip_special_tokens=False))
        return [next(exact if h else others) for h in held]

    def whole(self, texts: list[str]) -> list[np.ndarray] | list[list[int]]:
        """The sentencepiece library's ids of each text: arrays, which spare an object for each id, or lists where its version has no arrays."""
        encode = getattr(self.other, "encode_as_numpy", None) or self.other.encode
        return encode(texts, num_threads=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids one behind the other, how many each has, and whether they are the sentencepiece library's, which encodes every text as a whole."""
        odd = pc.match_substring_regex(texts, f"  |^ | $|^$|{MARK}").to_numpy(zero_copy_only=False)
        plain = ~odd & self.parted
        others = self.encode_batch(texts.filter(pa.array(~plain)).to_pylist())
        ids, counts, _ = encode_by_parts(texts.filter(pa.array(plain)), self.encode_batch, self.begins)
        ids, counts = interleaved(plain, ids, counts, others)
        expected = self.whole(texts.to_pylist())
        sizes = np.fromiter(map(len, expected), np.int64)
        if np.array_equal(sizes, counts) and np.array_equal(np.concatenate([ids[:0], *expected]), ids):
            return ids, counts, np.ones(len(texts), bool)
        own = np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []
        return ids, counts, np.array([np.array_equal(x, y) for x, y in zip(own, expected, strict=True)], bool)


_backends: dict[str, Backend] = {}


def backend_for(path: str) -> Backend:
    """The worker's own, kept from task to task."""
    if path not in _backends:
        _backends[path] = Backend(path)
    return _backends[path]


def model_path(path: str | None) -> str:
    if path is None:
        from .pattern_packing import vocabulary_path

        path = vocabulary_path("piece_bpe_32k.model")
    return path


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    backend = backend_for(path)
    for batch in joined(batches):
        ids, counts, parity = backend.encode(batch.column(1))
        ends = np.append(0, np.cumsum(counts))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
        raw = ids.astype("<u4")
        crcs = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed, pa.array(counts, pa.int64()), crcs, pa.array(parity)], ["doc_id", "text", "ids", "n_tokens", "ids_crc32", "parity"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    backend = backend_for(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            listed = some.column(some.schema.names.index("ids"))
            flat_ids, ends = listed.flatten().to_numpy(zero_copy_only=False).tolist(), pc.list_value_length(listed).fill_null(0).to_numpy().cumsum().tolist()
            ids = [flat_ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            texts, theirs = backend.decode_batch(ids), [backend.other.decode(x) if x else "" for x in ids]
            own = [pa.array(texts, pa.string()), pa.array([a == b for a, b in zip(texts, theirs, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*some.columns, *own], [*some.schema.names, "decoded", "decode_parity"])


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (which need ids) with decoded, the text of the ids, and decode_parity: whether the sentencepiece library decodes them to
    the same. Null and empty lists give empty texts."""
    path = model_path(path)
    return small_batches(rows).mapInArrow(lambda batches: _decoded(batches, path), StructType([*rows.schema.fields]).add("decoded", "string").add("decode_parity", "boolean"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, parity, round_trip, decode_parity for each row of docs (doc_id, text).

    ids_crc32 is of the little-endian unsigned 32-bit ids. parity: they are those of the sentencepiece library; round_trip: decode()
    gives the text (not so if it holds the metaspace mark itself); decode_parity: and what the sentencepiece library decodes. Null and
    empty texts have no ids. Texts are encoded and decoded whole. Repeated rows get equal results; a null doc_id stays null. Other
    columns are ignored; an empty table gives an empty result.
    """
    path = model_path(path)
    names = ["doc_id", "ids", "n_tokens", "ids_crc32", "parity", "round_trip", "decode_parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decoded(_encoded(batches, path), path):
            at = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"round_trip": pc.equal(batch["decoded"], batch["text"])}
            yield pa.RecordBatch.from_arrays([at[c] for c in names], names)

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean, decode_parity boolean")


def op10_sentencepiece_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir)).drop("ids")
