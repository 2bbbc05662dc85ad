"""Words of Arrow string columns as numpy arrays: positions and 64-bit hashes, without a Python object per word.

The helpers run inside Spark tasks.  Work goes through slices of a few megabytes of whole texts, so that the memory of a task
does not depend on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_BLOCK_WORDS = 1 << 16
_PRIME = 0x9E3779B97F4A7C15
_FIRST, _SECOND = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def spaces() -> np.ndarray:
    """True for the bytes that part words: the space and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def not_letters() -> np.ndarray:
    """True for every ASCII byte that is not a letter; bytes of longer characters count as letters."""
    table = np.zeros(256, bool)
    table[:128] = True
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1] = False
    return table


def not_alphanumeric() -> np.ndarray:
    """True for every ASCII byte that is neither a letter nor a digit."""
    table = not_letters()
    table[ord("0") : ord("9") + 1] = False
    return table


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table[data]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    values = values ^ (values >> np.uint64(33))
    values *= np.uint64(_FIRST)
    values ^= values >> np.uint64(33)
    values *= np.uint64(_SECOND)
    values ^= values >> np.uint64(33)
    return values


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offset of each text (one more at the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def compact(column: pa.Array) -> pa.Array:
    """The texts as an array of their own, null as empty: Arrow's kernels misread some slices that were cast."""
    data, offsets = text_bytes(column)
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has `rows` rows at most and `limit` bytes of text, or is a single text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(upto, before + limit, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """Words of consecutive texts: byte positions `starts`, `ends`, and `first`, the index of each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray):
        self.data, inside = data, ~gaps[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, length: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `length` bytes; whole words hash alike either way."""
        out = np.empty(len(self.starts), np.uint64)
        power = back = np.ones(1, np.uint64)
        for i in range(0, len(out), _BLOCK_WORDS):
            starts, ends = self.starts[i : i + _BLOCK_WORDS], self.ends[i : i + _BLOCK_WORDS]
            low, size = starts[0], ends[-1] - starts[0]
            if size >= len(power):
                power, back = _powers(2 * size)
            if length:
                ends = np.minimum(ends, starts + length)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((self.data[low : low + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
            out[i : i + _BLOCK_WORDS] = (sums[ends - low] - sums[starts - low]) * back[starts - low]
        return mixed(out)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    power, back = (np.full(size, factor, np.uint64) for factor in (_PRIME, pow(_PRIME, -1, 1 << 64)))
    power[0] = back[0] = 1
    return np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def text_words(column: pa.Array, gaps: np.ndarray, lower: bool) -> Words:
    """The words of an Arrow column of texts."""
    data, offsets = text_bytes(column)
    return Words(lowered(data) if lower else data, offsets, gaps)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every `length` consecutive values; the last ones, that would run over the end, are left out."""
    count = max(0, len(words) - length + 1)
    total = np.zeros(count, np.uint64)
    for i in range(length):
        total += words[i : i + count] * np.uint64(pow(_SECOND, i + 1, 1 << 64))
    return mixed(total)


def by_bucket(buckets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal buckets together, and where each of the `count` buckets begins in it."""
    order = np.argsort(buckets.astype(np.uint16 if count <= 1 << 16 else np.uint32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(buckets.astype(np.int64), minlength=count))])


def binary(rows: list) -> pa.Array:
    """numpy arrays as a binary column."""
    return pa.array([x.tobytes() for x in rows], pa.binary())


def joined(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """All arrays of a binary column, one after the other."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)
