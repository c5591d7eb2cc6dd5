"""Packing as a cutting-stock problem: column generation over the length histogram.

Documents are tokenised and closed with id END; longer ones give full sequences and a rest. A pattern is a multiset of lengths that fits into a sequence;
its cost is what the sequence takes when it is padded (nothing is padded at a power of two). The linear program "each length as often as the
histogram has it, at least cost" begins with one pattern for each length. A knapsack by dynamic programming finds, at the duals' prices, the
patterns worth more than they cost, and the simplex method takes them up until a lower bound is met. Repeats are rounded down.

What patterns leave is filled by cutting, which the contract allows: of equal sequences with a gap some are cut up to fill the gaps of the others, by
arithmetic alone, however many there are; the few items that rounding leaves form one stream that is cut at every full sequence, and its
tail at powers of two. Nothing is padded then, and the linear program has kept the cuts few. The plan needs the histogram alone (LENGTH numbers); executors
deal documents to it by their rank among those of the same length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pattern_packing import best_fit, opened, pieces, vocabulary_path, warn_of, with_offsets
from .shared import documents, scratch, stored

LENGTH = 1024
PLACED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
#: How far above its lower bound the linear program may stop, and what a sequence of another power of two costs besides its tokens, in full sequences.
TOLERANCE, SHORT = 1e-3, 0.02
#: What each pattern's repeats lose on the average when they are rounded, as far as the program need not be solved closer, in sequences; columns tried before one enters.
ROUNDED, TRIED = 0.003, 16
#: Weight of the best bound's prices where new patterns are looked for.
SMOOTH = 0.7


def cost(total: int, room: int) -> float:
    """What a sequence of total tokens takes, in full sequences."""
    if total == room:
        return 1.0
    return total / room + SHORT if total & (total - 1) == 0 else 1.0


def knapsack(lengths: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value of lengths that add up to each total exactly, and the index of a length in it (-1: none)."""
    best, last = np.full(room + 1, -np.inf), np.full(room + 1, -1)
    best[0] = 0.0
    for total in range(int(lengths[0]), room + 1):
        own = best[total - lengths[: np.searchsorted(lengths, total, "right")]]
        own = own + prices[: len(own)]
        k = int(own.argmax())
        if own[k] > -np.inf:
            best[total], last[total] = own[k], k
    return best, last


def column_generation(lengths: np.ndarray, demand: np.ndarray, room: int, tolerance: float = TOLERANCE, rounded: float = ROUNDED) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Patterns (how often each length), their repeats (not yet whole), and a lower bound on the cost of any packing without cuts."""
    m = len(lengths)
    costs_of = np.array([cost(t, room) for t in range(1, room + 1)])
    basis = np.diag(np.maximum(1, room // lengths)).astype(float)
    basis_cost = np.array([cost(int(t), room) for t in basis.diagonal() * lengths])
    inverse, x = np.diag(1 / basis.diagonal()), demand / basis.diagonal()
    prices = basis_cost @ inverse
    bound, pivots, centre = float(lengths @ demand) / room, 0, lengths / room
    index = {int(w): k for k, w in enumerate(lengths)}
    known: set[bytes] = set()
    pool, pool_cost = np.empty((m, 0)), np.empty(0)

    def add(patterns: list[np.ndarray]) -> None:
        nonlocal pool, pool_cost
        new = {key: p for p in patterns if (key := p.tobytes()) not in known}
        known.update(new)
        pool = np.hstack([pool, *(p[:, None] for p in new.values())])
        pool_cost = np.append(pool_cost, [cost(int(p @ lengths), room) for p in new.values()])

    def pattern(held: list[int]) -> np.ndarray:
        p = np.zeros(m)
        np.add.at(p, held, 1)
        return p

    def priced(at: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The dearest ratio of worth to cost at these prices, and patterns worth more than they cost: the best of each total, and for each length the best that holds it."""
        best, last = knapsack(lengths, at, room)
        upto = [0]
        for total in range(1, room + 1):
            upto.append(total if best[total] > best[upto[-1]] else upto[-1])

        def held(total: int) -> list[int]:
            found = []
            while total:
                found.append(int(last[total]))
                total -= int(lengths[last[total]])
            return found

        worth = best[1:] / costs_of
        ends = [held(int(t)) for t in np.flatnonzero(worth > 1 + 1e-9) + 1]
        own = [[k, *held(upto[room - int(w)])] for k, w in enumerate(lengths) if at[k] + best[upto[room - int(w)]] > 1 + 1e-9]
        return float(worth.max()), [pattern(h) for h in ends + own]

    add([pattern([index[c] for c in cells]) for _, cells in best_fit(dict(zip(lengths.tolist(), demand.astype(int).tolist(), strict=True)), room)])
    while basis_cost @ x > bound * (1 + tolerance) + rounded * m:
        gains = prices @ pool - pool_cost
        some = np.argsort(-gains)[:TRIED]
        some = some[gains[some] > 1e-9]
        if not len(some):
            if pool.shape[1] > 4 * m:  # what is dear at these prices goes; it is found again if prices turn
                kept = np.argsort(-gains, kind="stable")[: 2 * m]
                pool, pool_cost = pool[:, kept], pool_cost[kept]
                known.clear()
                known.update(p.tobytes() for p in pool.T.copy())
            columns: list[np.ndarray] = []
            for weight in (SMOOTH, 0.0):  # prices between the present ones and those of the best bound first: present ones alone swing
                at = weight * centre + (1 - weight) * prices
                ratio, columns = priced(at)
                if at @ demand / max(1.0, ratio) > bound:
                    bound, centre = float(at @ demand / max(1.0, ratio)), at
                columns = [p for p in columns if prices @ p > cost(int(p @ lengths), room) + 1e-9]
                if columns:
                    break
            if not columns:
                break
            add(columns)
            continue
        ways = inverse @ pool[:, some]
        ratios = np.where(ways > 1e-7, x[:, None] / np.where(ways > 1e-7, ways, 1), np.inf)
        steps = ratios.min(axis=0)
        chosen = int((gains[some] * steps + 1e-12 * gains[some]).argmax())  # of the dearest columns the one that saves most
        enters, way, step = int(some[chosen]), ways[:, chosen], steps[chosen]
        leaves = int(np.where(ratios[:, chosen] <= step + 1e-9 * (1 + step), way, 0).argmax())  # of ties the largest pivot, so that the basis stays regular
        x = np.maximum(x - step * way, 0)
        x[leaves] = step
        basis[:, leaves], basis_cost[leaves] = pool[:, enters], pool_cost[enters]
        pivots += 1
        row = inverse[leaves] / way[leaves]
        inverse -= np.outer(way, row)
        inverse[leaves] = row
        if pivots % 500 == 0:
            inverse = 2 * inverse - inverse @ basis @ inverse  # takes back what rounding added up to
            x = np.maximum(inverse @ demand, 0)
        prices = basis_cost @ inverse
    return [basis[:, k].astype(np.int64) for k in range(m)], x, bound


def plan(histogram: dict[int, int], room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots, the bounds of the tail's sequences and the tail's number.

    A slot: cell, first rank, pitch, at, gap, first sequence, filled. The item of a rank stands in a stream from (rank - first rank) * pitch + at on; the stream is
    cut after every gap tokens, and part k goes to sequence first + k behind what is filled there. A whole item in its sequence is a stream with gap = room.
    The tail is one sequence of the stream at the end; its parts up to each bound are sequences of their own.
    """
    lengths = np.array(sorted(histogram), np.int64)
    left = {cell: int(histogram[cell]) for cell in lengths.tolist()}
    groups: list[tuple[int, list[int]]] = []
    if len(lengths):
        found, x, _ = column_generation(lengths, np.array([left[c] for c in lengths.tolist()], float), room)
        for k in np.argsort(-x, kind="stable"):
            cells = [int(c) for c, n in zip(lengths[::-1], found[k][::-1], strict=True) for _ in range(n)]
            repeats = min(int(x[k] + 1e-6), *(left[c] // cells.count(c) for c in set(cells)))
            if repeats > 0:
                groups.append((repeats, cells))
                for c in cells:
                    left[c] -= repeats
    ranks, slots, sequence = dict.fromkeys(left, 0), [], 0

    def place(cells: list[int], repeats: int, pitch: int, gap: int, first: int, filled: int, at: int = 0) -> None:
        for c in cells if repeats else ():
            slots.append((c, ranks[c], pitch, at, gap, first, filled))
            ranks[c] += repeats
            at += c

    def unpadded(total: int) -> bool:
        return total == room or total & (total - 1) == 0

    for repeats, cells in groups:
        total = sum(cells)
        if unpadded(total):
            place(cells, repeats, room, room, sequence, 0)
            sequence += repeats
            continue
        gap = room - total
        even = gap // np.gcd(total, gap)
        donors = repeats * gap // room // even * even  # so many give whole gaps
        taken = donors * total // gap
        place(cells, taken, room, room, sequence, 0)
        place(cells, donors, total, gap, sequence, total)
        sequence += taken
        for c in cells:
            left[c] += repeats - donors - taken
    stream = 0
    for repeats, cells in best_fit({c: n for c, n in left.items() if n}, room):
        if unpadded(sum(cells)):
            place(cells, repeats, room, room, sequence, 0)
            sequence += repeats
    rest = [c for repeats, cells in best_fit({c: n for c, n in left.items() if n}, room) if not unpadded(sum(cells)) for _ in range(repeats) for c in cells]
    for c in rest:
        place([c], 1, room, room, sequence, 0, stream)
        stream += c
    tail, over = sequence + stream // room, stream % room
    parts = [1 << k for k in reversed(range(room.bit_length())) if over >> k & 1]
    return np.array(sorted(slots), np.int64).reshape(-1, 7), np.cumsum(parts, dtype=np.int64), tail


def fragments(slots: np.ndarray, bounds: np.ndarray, tail: int, cells: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """For items by cell and rank: which item, start in it, length, sequence and offset of each of their parts, item by item."""
    k = np.searchsorted(slots[:, 0] << 44 | slots[:, 1], cells << 44 | ranks, "right") - 1
    _, first_rank, pitch, at, gap, first, filled = slots[k].T
    start = (ranks - first_rank) * pitch + at
    end = start + cells
    n = (end - 1) // gap - start // gap + 1
    item = np.repeat(np.arange(len(cells)), n)
    part = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + (start // gap)[item]
    low, high = np.maximum(start[item], part * gap[item]), np.minimum(end[item], (part + 1) * gap[item])
    within, size, sequence, offset = low - start[item], high - low, first[item] + part, filled[item] + low - part * gap[item]
    if not len(bounds):
        return item, within, size, sequence, offset
    last = sequence == tail
    one, two = (np.where(last, np.searchsorted(bounds, x, "right"), 0) for x in (offset, offset + size - 1))
    n = two - one + 1
    again = np.repeat(np.arange(len(item)), n)
    part = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n) + one[again]
    begins = np.where(last[again], np.append(0, bounds)[part], 0)
    ends = np.where(last[again], np.append(bounds, 0)[part], np.iinfo(np.int64).max)
    low, high = np.maximum(offset[again], begins), np.minimum((offset + size)[again], ends)
    return item[again], (within - offset)[again] + low, high - low, sequence[again] + part, low - begins


def pack(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids for each piece of each row of docs (doc_id, text).

    A sequence's pieces stand in one partition, by offset. Every sequence has length tokens but those of the tail, whose lengths are powers of two (length must be
    one). Null and empty texts are one piece, the closing id. A text of any length is encoded whole. Ties are broken by task and place; repeated rows are
    packed each by itself. A null doc_id stays null. Other columns are ignored; an empty table gives no pieces. The vocabulary files are parameters.
    """
    if json_path is None:
        json_path, ranks_path = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
    differing = docs.sparkSession.sparkContext.accumulator(0)
    with scratch(docs.sparkSession):
        cut = stored(pieces(docs, json_path, ranks_path, length, differing), "pieces", keep=True)
        warn_of(differing)
        histogram = {cell: n for cell, n in cut.groupBy("cell").count().collect()}  # as many rows as there are lengths
        full = {c: n for c, n in histogram.items() if c == length}
        slots, bounds, tail = plan({c: n for c, n in histogram.items() if c < length}, length)
        beyond = 1 << 40  # full pieces are sequences of their own, numbered from here on
        if full:
            slots = np.vstack([slots, np.array([(length, 0, length, 0, length, beyond, 0)], np.int64)])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                cells, ids = at["cell"].to_numpy().astype(np.int64), at["ids"]
                if not len(ids):
                    continue
                item, within, size, sequence, offset = fragments(slots, bounds, tail, cells, at["before"].to_numpy() + at["place"].to_numpy())
                ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
                width = int(ends[1] - ends[0]) // int(cells[0])
                starts = np.append(ends[:-1][item] + within * width, ends[-1]).astype(np.int32)  # parts follow each other as they did
                held = pa.BinaryArray.from_buffers(pa.binary(), len(item), [None, pa.py_buffer(starts.tobytes()), ids.buffers()[2]])
                taken = pa.array(item)
                own = [at["doc_id"].take(taken), pa.array(at["start"].to_numpy()[item] + within), pa.array(size), at["doc_tokens"].take(taken), held, pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(own, re.findall(r"(\w+) \w+", PLACED))

        placed = with_offsets(cut).mapInArrow(place, PLACED)
    return opened(placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset"), PACKED)


def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids")
