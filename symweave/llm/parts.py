"""Encoding many texts by their different words: what stands between single spaces is encoded once for each batch.

The vocabularies at hand never join what single spaces part: a part's first token begins with the space, and no other token of it does. So the
different parts of a batch are encoded in runs, joined by spaces; where tokens that begin with a space stand, the ids fall into parts again; and each
text's ids are gathered from its parts. Everything but the encoding itself is done on whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = 128


class PartsRun(ValueError):
    """Parts run into each other: their ids can't be told apart."""


def joined(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches that follow each other, as one while they hold no more than most bytes together: the more texts, the fewer different parts for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def flat(lists: Iterable[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ids[start : start + size] for all starts and sizes, one behind the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def encode_by_parts(
    texts: pa.Array, encode: Callable[[list[str]], Iterable[list[int]]], begins: np.ndarray, lead: str = "", right: Callable[[list[str], np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' ids one behind the other, how many each has, and whether right says so of all its parts.

    Texts neither are empty nor hold two spaces in a row, one at the start or one at the end. begins: for each id whether it begins a
    part. lead: what stands before a run of parts; if it is a space, a text's first part differs from others, as it has none before it.
    right: of different parts and their ids, whether each part's are right.
    """
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    split = pc.split_pattern(texts, " ")
    offsets = np.asarray(split.offsets)
    words = split.flatten().dictionary_encode()
    codes, different = words.indices.to_numpy().astype(np.int64), words.dictionary
    runs = pa.ListArray.from_arrays(pa.array([*range(0, len(different), RUN), len(different)], pa.int32()), different)
    ids = flat(encode([lead + run for run in pc.binary_join(runs, " ").to_pylist()]))
    starts = np.flatnonzero(begins[ids])
    if len(starts) != len(different):
        raise PartsRun("a part's ids can't be told from the next part's")
    sizes = np.diff(starts, append=len(ids))
    fine = np.logical_and.reduceat(right(different.to_pylist(), ids)[codes], offsets[:-1]) if right else np.ones(len(texts), bool)
    if lead:
        own = list(encode(different.take(pa.array(codes[offsets[:-1]])).to_pylist()))
        own_sizes = np.array(list(map(len, own)))
        codes[offsets[:-1]] = len(sizes) + np.arange(len(own))
        starts, sizes = np.append(starts, len(ids) + np.cumsum(own_sizes) - own_sizes), np.append(sizes, own_sizes)
        ids = np.append(ids, flat(own))
    return gather(ids, starts[codes], sizes[codes]), np.add.reduceat(sizes[codes], offsets[:-1]), fine


def interleaved(plain: np.ndarray, ids: np.ndarray, counts: np.ndarray, others: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts of all texts in order, from those of plain ones and a list for each of the others."""
    if plain.all():
        return ids, counts
    own = np.array(list(map(len, others)), np.int64)
    sizes, starts = np.empty(len(plain), np.int64), np.empty(len(plain), np.int64)
    sizes[plain], sizes[~plain] = counts, own
    starts[plain], starts[~plain] = np.cumsum(counts) - counts, len(ids) + np.cumsum(own) - own
    return gather(np.append(ids, flat(others)), starts, sizes), sizes
