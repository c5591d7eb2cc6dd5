"""Packing by patterns: non-negative least squares over the length histogram.

Documents are tokenised, closed with id END and cut into pieces of at most LENGTH tokens (the first piece may be shorter). Lengths
are counted. Patterns of one to three pieces that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares, rounded down to what the histogram has, and the residual is packed
best-fit decreasing, by counts. The plan needs the histogram alone (LENGTH numbers), however many pieces there are.

Executors then deal pieces to the plan's slots: a piece's rank among those of its cell is its task's offset plus its place
within the task; ranks map to slots by binary search. No task gathers the pieces of a frequent length. The ids are stored with the
pieces, and then dealt once, by sequence.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .parts import PartsRun, encode_by_parts, flat, interleaved
from .shared import documents, scratch, small_batches, stored

LENGTH, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids binary, cell int, task int, place long, doc_tokens long"
PLACED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# tokens

#: What Unicode calls white space, for Arrow's regular expressions. Texts with two in a row, or one at an end, are encoded as a whole.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ODD = f"{WHITE}{WHITE}|^{WHITE}|{WHITE}$"
#: One text in so many, by the checksum of its bytes, is compared with what the tokenizers library gives for the whole text.
CHECKED = 64


class Encoder:
    """Ids as the tokenizers library gives them for json_path, special tokens' names in texts being read as it reads them by default.

    Parts go through tiktoken where ranks_path has the same vocabulary as ranks, which is several times faster; one text in CHECKED
    is compared with the tokenizers library. A batch with a difference is encoded by that library as a whole, and counted in differing. Texts with a special token go through that library as a whole.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: what ids are stored and dealt as
        self.kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.fast: Callable[[str], list[int]] | None = None
        self.differing = 0
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def ordinary(self, texts: list[str]) -> list[list[int]]:
        """Texts that hold no special token."""
        return list(map(self.fast, texts)) if self.fast else self.slow(texts)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one behind the other, and how many each has."""
        special = np.zeros(len(texts), bool)
        for name in self.special:
            special |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        plain = ~special & ~pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) & (pc.binary_length(texts).to_numpy() > 0)
        others = [self.slow([t])[0] if s else self.ordinary([t])[0] for t, s in zip(texts.filter(pa.array(~plain)).to_pylist(), special[~plain], strict=True)]
        try:
            ids, counts = interleaved(plain, *encode_by_parts(texts.filter(pa.array(plain)), self.ordinary, self.begins, " ")[:2], others)
        except PartsRun:
            return self.whole(texts)
        if self.fast:
            ends = np.cumsum(counts)
            chosen = [i for i, t in enumerate(texts) if zlib.crc32(t.as_buffer() or b"") % CHECKED == 0]
            for i, expected in zip(chosen, self.slow([texts[i].as_py() for i in chosen]), strict=True):
                if ids[ends[i] - counts[i] : ends[i]].tolist() != expected:
                    return self.whole(texts)
        return ids, counts

    def whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self.differing += 1
        found = self.slow(texts.to_pylist())
        return flat(found), np.array(list(map(len, found)), np.int64)


_encoders: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    """The worker's own, kept from task to task."""
    key = json_path, ranks_path
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def ranks_within(cells: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each place's rank among those of its cell, from before[cell] on, which is brought up to date."""
    order = np.argsort(cells, kind="stable")
    kinds, first, n = np.unique(cells[order], return_index=True, return_counts=True)
    found = np.empty(len(cells), np.int64)
    found[order] = np.arange(len(cells)) - np.repeat(first - before[kinds], n)
    before[kinds] += n
    return found


def warn_of(differing: Accumulator) -> None:
    if differing.value:
        warnings.warn(f"{differing.value} batches of texts were encoded by the tokenizers library, as the faster one's ids differ there", stacklevel=2)


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, length: int = LENGTH, differing: Accumulator | None = None) -> DataFrame:
    """A row for each piece of each document, with its ids (2 bytes each if the vocabulary allows that, else 4), its cell and its
    place among those of its cell in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        task, before = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            so_far, (ids, counts) = encode.differing, encode(batch.column(1))
            if differing is not None and encode.differing > so_far:
                differing.add(1)
            closed = np.insert(ids, np.cumsum(counts), END).astype(encode.kind)
            sizes = counts + 1
            n, first = -(-sizes // length), (sizes - 1) % length + 1
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            own = np.where(piece == 0, first[doc], length)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * length)
            ends = pa.array(np.append(0, np.cumsum(own) * closed.itemsize), pa.int32())
            held = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, ends.buffers()[1], pa.py_buffer(closed.tobytes())])
            numbers = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(own, pa.int64()), held, pa.array(own, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *numbers, pa.array(np.full(len(own), task), pa.int32()), pa.array(ranks_within(own, before)), pa.array(sizes[doc])], re.findall(r"(\w+) \w+", PIECES))

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(cut, PIECES)


# the plan


def patterns(room: int) -> list[tuple[int, ...]]:
    """Lengths of one to three pieces that fill a sequence exactly, longest first: one piece, all pairs, and for each longest piece the
    triples that split the rest evenly, two to one and three to one."""
    found = {(room,): None}
    found |= {(room - b, b): None for b in range(1, room // 2 + 1)}
    for a in range(room - 2, 0, -1):
        for share in (2, 3, 4):
            c = (room - a) // share
            if c and room - a - c <= a:
                found[a, room - a - c, c] = None
    return list(found)


def nnls(kinds: list[tuple[int, ...]], histogram: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """Repeats x >= 0 of each pattern with the least weighted squared distance between what they use and the histogram.

    Coordinate descent: each repeat count in turn is set to its best value given the others, which needs the few lengths of its
    pattern only, until a sweep over all moves less than tolerance of all repeats. Lengths weigh as their square, since long pieces are the
    hard ones to place otherwise.
    """
    x = [0.0] * len(kinds)
    rest = histogram.astype(float).tolist()
    uses = [[(cell, kind.count(cell), float(cell) ** 2) for cell in dict.fromkeys(kind)] for kind in kinds]
    norms = [sum(w * n * n for _, n, w in own) for own in uses]
    moved = float("inf")
    while moved > tolerance * sum(x):
        moved = 0.0
        for k, own in enumerate(uses):
            step = max(-x[k], sum(w * n * rest[cell] for cell, n, w in own) / norms[k])
            if step:
                x[k] += step
                moved += abs(step)
                for cell, n, _ in own:
                    rest[cell] -= n * step
    return np.array(x)


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """(repeats, lengths of the pieces in order) for groups of equal sequences that hold each piece of the histogram once."""
    left = np.zeros(room + 1, np.int64)
    for cell, n in histogram.items():
        left[cell] = n
    kinds, groups = patterns(room), []
    fitted = nnls(kinds, left)
    for k in np.argsort(-fitted, kind="stable"):
        repeats = min(int(fitted[k] + 1e-6), *(int(left[cell]) // kinds[k].count(cell) for cell in kinds[k]))
        if repeats > 0:
            groups.append((repeats, list(kinds[k])))
            for cell in kinds[k]:
                left[cell] -= repeats
    return groups + best_fit({cell: int(n) for cell, n in enumerate(left) if n}, room)


def best_fit(histogram: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing by counts: equal pieces go together, each into the fullest sequences that still have room."""
    opened: list[list[tuple[int, list[int]]]] = [[] for _ in range(room + 1)]  # groups of equal sequences by room left
    for cell in sorted(histogram, reverse=True):
        n, fit = histogram[cell], cell
        while n:
            while fit < room and not opened[fit]:
                fit += 1
            if fit == room:
                each = room // cell
                for repeats, times in ((n // each, each), (1, n % each)):
                    if repeats and times:
                        opened[room - cell * times].append((repeats, [cell] * times))
                break
            repeats, held = opened[fit].pop()
            if repeats > n:
                opened[fit].append((repeats - n, held))
            took = min(n, repeats)
            opened[fit - cell].append((took, [*held, cell]))
            n -= took
            fit = cell
    return [g for some in opened for g in some]


def slots(groups: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (cell, first rank, first sequence, offset in the sequence), sorted: ranks from there on go to successive sequences."""
    ranks, found, sequence = defaultdict(int), [], 0
    for repeats, cells in groups:
        offset = 0
        for cell in cells:
            found.append((cell, ranks[cell], sequence, offset))
            ranks[cell] += repeats
            offset += cell
        sequence += repeats
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def with_offsets(cut: DataFrame, most: int = 32 << 20) -> DataFrame:
    """cut (task, cell, place and more), with how many places earlier tasks have of a row's cell, as before.

    A task's offsets are a map of as many entries as there are lengths. All maps are broadcast if they take most bytes together; beyond that they
    meet the rows in a sort-merge join by task, which moves the ids once more.
    """
    counts = stored(cut.groupBy("task", "cell").agg(F.count(F.lit(1)).alias("n")), "counts", keep=True)
    earlier = Window.partitionBy("cell").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", F.struct("cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).alias("own"))
    by_task = offsets.groupBy("task").agg(F.map_from_entries(F.collect_list("own")).alias("befores"))
    small = counts.count() * 16 <= most
    joined = cut.join(F.broadcast(by_task), "task") if small else cut.join(by_task.hint("merge"), "task")
    return joined.withColumn("before", F.element_at("befores", F.col("cell"))).drop("befores")


def opened(placed: DataFrame, schema: str = PACKED) -> DataFrame:
    """The columns of schema: ids as integers, and their digest, which is of little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            lengths = at["length"].to_numpy()
            ids = [np.frombuffer(x.as_py(), f"<u{len(x.as_py()) // n}").astype("<u4") for x, n in zip(at["ids"], lengths, strict=True)]
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)))
            at |= {"ids": listed, "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())}
            names = re.findall(r"(\w+) [\w<>]+", schema)
            yield pa.RecordBatch.from_arrays([at[c] for c in names], names)

    return placed.mapInArrow(run, schema)


def pack(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids for each piece of each row of docs (doc_id, text).

    A sequence's pieces stand in one partition, by offset: their ids in this order are the packed sequence. ids_crc32 is taken from
    the ids after they were dealt. Null and empty texts are one piece, the closing id. A text of any length is encoded whole. Ties are
    broken by task and place; repeated rows are packed each by itself. A null doc_id stays null. Other columns are ignored; an
    empty table gives no pieces. The vocabulary files are parameters.
    """
    if json_path is None:
        json_path, ranks_path = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
    differing = docs.sparkSession.sparkContext.accumulator(0)
    with scratch(docs.sparkSession):
        cut = stored(pieces(docs, json_path, ranks_path, length, differing), "pieces", keep=True)
    warn_of(differing)
    histogram = {cell: n for cell, n in cut.groupBy("cell").count().collect()}  # as many rows as there are lengths
    table = slots(plan(histogram, length))
    keys = table[:, 0] << 44 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rank = at["before"].to_numpy() + at["place"].to_numpy()
            k = np.searchsorted(keys, at["cell"].to_numpy().astype(np.int64) << 44 | rank, "right") - 1
            own = [at[c] for c in ("doc_id", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(table[k, 2] + rank - table[k, 1]), pa.array(table[k, 3])], re.findall(r"(\w+) \w+", PLACED))

    placed = with_offsets(cut).mapInArrow(place, PLACED)
    return opened(placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids")
