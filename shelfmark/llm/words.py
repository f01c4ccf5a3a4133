"""Words of whole texts, an Arrow batch at a time.

A word is a longest run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return.  Words of a batch are numbered, so work on a word
is done once for its distinct spellings, and the rest is array arithmetic.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: bytes of text handled at once, unless one text alone is longer
SLICE_BYTES = 8 * 1024 * 1024


class Words(NamedTuple):
    codes: np.ndarray  # of each word, its number in the vocabulary
    vocabulary: pa.Array  # distinct words
    offsets: np.ndarray  # words of text i are codes[offsets[i]:offsets[i + 1]]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owners(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text (null: none); ``lower`` folds A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    # text that begins or ends with white space leaves an empty piece there
    keep = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    pieces = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    encoded = flat.filter(keep).dictionary_encode()
    return Words(encoded.indices.to_numpy(), encoded.dictionary, before[pieces].astype(np.int64))


def hashes(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hash of each word, equal in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX1
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX2
    return values ^ (values >> np.uint64(31))


def windows(hashed: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one text, and the offsets by text."""
    counts = np.diff(offsets)
    inside = np.maximum(counts - size + 1, 0)
    n = max(len(hashed) - size + 1, 0)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value * _ODD + hashed[k : k + n]
    # a run that leaves its text starts among the last size - 1 words of it
    starts = np.arange(len(hashed)) - np.repeat(offsets[:-1], counts)
    keep = (starts < np.repeat(inside, counts))[:n]
    return mixed(value[keep]), np.concatenate([[0], np.cumsum(inside)]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def give_back() -> None:
    """Hands memory that is free in this worker back to the machine: the worker
    waits for its next task while the executor's other half needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = SLICE_BYTES) -> Callable:
    """A function for ``mapInArrow`` that applies ``work`` slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=most):
                yield work(part)
        give_back()

    return run
