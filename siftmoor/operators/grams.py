"""Grams: runs of up to four bytes of a line, by which an inverted index of patterns is entered.

A gram is known by a number: its bytes, lowest first, and its length above them.  Tasks look through the bytes of whole
batches of texts at once and hand on only (line, gram) pairs whose gram may be indexed,
by a filter that has the same size for a catalogue of any size.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.functions.text import fold_case

GRAM = 4
SLICE_BYTES = 8 << 20
_FILTER_BITS = 20
_LENGTH_SHIFT = 8 * GRAM
_KEY_BITS = _LENGTH_SHIFT + GRAM.bit_length()


def gram_number(gram: bytes) -> int:
    return int.from_bytes(gram, "little") | len(gram) << _LENGTH_SHIFT


def gram_length(number: Column) -> Column:
    return F.shiftright(number, _LENGTH_SHIFT).cast("int")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more at the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)), offsets - offsets[0]


def _spread(numbers: np.ndarray) -> np.ndarray:
    return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


def _grams_at(data: np.ndarray, length: int) -> np.ndarray:
    """The number of the gram that begins at each byte."""
    numbers = np.full(max(0, len(data) - length + 1), length << _LENGTH_SHIFT, np.int64)
    for i in range(length):
        numbers |= data[i:i + len(numbers)].astype(np.int64) << (8 * i)
    return numbers


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        upto, start = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def gram_slots(numbers: list[int]) -> list[int]:
    """The places of grams in a filter."""
    return _spread(np.array(numbers, np.int64)).astype(np.int64).tolist()


def _indexed(filled: bytes, lengths: list[int]):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(np.frombuffer(filled, np.uint8), bitorder="little").astype(bool)
        for batch in _slices(batches):
            data, offsets = _bytes(batch["folded"])
            ends = np.flatnonzero(data == 10)
            found = []
            for length in lengths:
                numbers = _grams_at(data, length)
                at = np.flatnonzero(maybe[_spread(numbers)])
                file = np.searchsorted(offsets, at, "right") - 1
                inside = at + length <= offsets[file + 1]
                at, file = at[inside], file[inside]
                # Lines are counted through the slice: a file's first one follows the last one of the file before.
                found.append((np.searchsorted(ends, at) + file) << _KEY_BITS | numbers[at])
            pairs = np.unique(np.concatenate(found))
            line, gram = pairs >> _KEY_BITS, pairs & ((1 << _KEY_BITS) - 1)
            first = np.searchsorted(ends, offsets) + np.arange(len(offsets))
            file = np.searchsorted(first, line, "right") - 1
            text, starts = _bytes(batch["text"])
            # Both texts have the same line ends, and the edge of a file ends a line as well.
            edges = np.sort(np.concatenate([np.flatnonzero(text == 10), starts[1:] - 0.5]), kind="stable")
            opens = np.floor(np.concatenate([[-1], edges]) + 1).astype(np.int64)
            closes = np.ceil(edges).astype(np.int64)
            lines = [text[a:b].tobytes() for a, b in zip(opens[line], closes[line])]
            own = pa.array(file)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(own) for c in ("repo_id", "path", "language")), pa.array((line - first[file] + 1).astype(np.int32)),
                 pa.array(lines, pa.binary()).cast(pa.string()), pa.array(gram)],
                ["repo_id", "path", "language", "line_number", "line", "gram"])

    return indexed


def gram_filter(slots: DataFrame) -> bytes:
    """The bits of a filter of fixed size (128 KB), from the places (``slot``) of any number of grams."""
    parts = slots.select(F.col("slot").cast("long").alias("slot")).groupBy(F.floor(F.col("slot") / 32768).alias("part")).agg(
        F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")).collect()
    filled = bytearray((1 << _FILTER_BITS) // 8)
    for row in parts:      # 32 at most
        filled[row.part * 4096:(row.part + 1) * 4096] = row.bits
    return bytes(filled)


def indexed_lines(file_text: DataFrame, filled: bytes, lengths: list[int]) -> DataFrame:
    """(repo_id, path, language, line_number, line, gram): each line with each gram of its folded text that has one of the
    ``lengths`` and its place in the filter filled, once.  Few of them are grams that are not indexed."""
    texts = file_text.where(F.col("text").isNotNull()).select("repo_id", "path", "language", "text", fold_case(F.lower("text")).alias("folded"))
    return texts.mapInArrow(_indexed(filled, lengths), "repo_id string, path string, language string, line_number int, line string, gram long")
