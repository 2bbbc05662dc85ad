"""Removal of repeated passages by super-k-mer partitioning.

A window is `window` consecutive words of a document.  The minimiser of a window is the smallest hash of its runs of MER words.
Consecutive windows with one minimiser travel as one packed string to the minimiser's bucket, so that equal windows of all
documents meet.  There the windows are sorted, compared word by word, and those that also start in a document with a smaller
id are told to their document, which leaves out the words they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import buckets_for, text_size

WINDOW, MER = 13, 3
BUCKET_BYTES = 12 << 20
_COUNTS = np.dtype([("strings", np.int64), ("text", np.int64), ("found", np.int64)])


def _smallest(values: np.ndarray, length: int) -> np.ndarray:
    """The minimum of every `length` consecutive values."""
    done = 1
    while 2 * done <= length:
        values, done = np.minimum(values[:-done], values[done:]), 2 * done
    rest = length - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after the other."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def _sequences(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each span of words."""
    power, back = w._powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return w.mixed((sums[starts + sizes] - sums[starts]) * back[starts] + sizes.astype(np.uint64))


class _Strings:
    """Super-k-mers: document, first word, number of words; and occurrences already known to repeat."""

    def __init__(self, ids: np.ndarray, words: w.Words, window: int):
        self.words, hashes = words, words.hashes()
        count, mer = len(hashes), min(MER, window)
        self.doc = self.start = self.size = self.home = np.zeros(0, np.int64)
        self.repeats = np.zeros((0, 3), np.int64)
        if count < window:
            return
        text = words.texts()
        least = _smallest(w.runs(hashes, mer), window - mer + 1)
        inside = np.flatnonzero(text[: count - window + 1] == text[window - 1 :])
        if not len(inside):
            return
        value = least[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (value[1:] != value[:-1]) | (inside[1:] != inside[:-1] + 1) | (text[inside[1:]] != text[inside[:-1]])
        at = np.flatnonzero(new)
        windows = np.diff(np.append(at, len(inside)))
        start, size, home = inside[at], windows + window - 1, value[at]
        doc = ids[text[start]]
        # Equal strings of this piece: only those of the smallest document travel; the others repeat it for certain.
        key = _sequences(hashes, start, size)
        order = np.lexsort((doc, key))
        first = np.ones(len(order), bool)
        first[1:] = key[order[1:]] != key[order[:-1]]
        least_doc = np.repeat(doc[order[first]], np.diff(np.append(np.flatnonzero(first), len(order))))
        travels = np.zeros(len(order), bool)
        travels[order] = doc[order] == least_doc
        own = start - words.first[text[start]]
        self.repeats = np.stack([doc[~travels], own[~travels], own[~travels] + size[~travels]], axis=1)
        self.doc, self.start, self.size, self.home, self.own = (x[travels] for x in (doc, start, size, home, own))


def _cut(count: int, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in w.slices(batches, "text"):
            strings = _Strings(batch["id"].to_numpy(), w.text_words(batch["text"], w.spaces(), False), window)
            words, rows = strings.words, []
            order, upto = w.by_bucket(w.mixed(strings.home.astype(np.uint64)) % np.uint64(count), count)
            lost = int(strings.repeats[0, 0]) % count if len(strings.repeats) else -1
            for bucket in np.flatnonzero((np.diff(upto) > 0) | (np.arange(count) == lost)):
                these = order[upto[bucket] : upto[bucket + 1]]
                low, size = words.starts[strings.start[these]], 0
                high = words.ends[strings.start[these] + strings.size[these] - 1]
                text, size = words.data[_spans(low, high - low)], high - low
                repeats = strings.repeats if bucket == lost else strings.repeats[:0]
                head = np.array([(len(these), len(text), len(repeats))], _COUNTS)
                rows.append((int(bucket), packer.compress(b"".join(x.tobytes() for x in (
                    head, strings.doc[these], strings.own[these].astype(np.int32), size.astype(np.int32), repeats, text)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])

    return cut


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    head, at, out = np.frombuffer(raw, _COUNTS, 1)[0], _COUNTS.itemsize, []
    for kind, count in ((np.int64, head["strings"]), (np.int32, head["strings"]), (np.int32, head["strings"]), (np.int64, 3 * head["found"]), (np.uint8, head["text"])):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return tuple(out)


def _leaders(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that start at `at` in which equal ones are together, and whether each opens a new group.

    Windows are sorted by a hash and compared word by word; only if hashes of different windows meet, by all their words.
    """
    key = w.runs(hashes, window)[at]
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    same = np.flatnonzero(~new)
    one, other = at[order[same]], at[order[same - 1]]
    for i in range(window):
        if (hashes[one + i] != hashes[other + i]).any():
            columns = [hashes[at + j] for j in range(window)]
            order = np.lexsort(columns)
            new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
            break
    return order, new


def _meet(window: int):
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_buffer()) for x in table["packed"]]
        doc, own, size, repeats, text = (np.concatenate([p[i] for p in parts]) for i in range(5))
        words = w.Words(text, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), w.spaces())
        hashes, string = words.hashes(), words.texts()
        at = np.flatnonzero(string[: len(string) - window + 1] == string[window - 1 :]) if len(string) >= window else np.zeros(0, np.int64)
        found = np.zeros((0, 3), np.int64)
        if len(at):
            order, new = _leaders(hashes, at, window)
            owner = doc[string[at]]
            opens = np.flatnonzero(new)
            least = np.minimum.reduceat(owner[order], opens)
            repeated = np.zeros(len(at), bool)
            repeated[order] = owner[order] > np.repeat(least, np.diff(np.append(opens, len(order))))
            at = at[repeated]
            if len(at):
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (string[at[1:]] != string[at[:-1]])
                first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
                begin = own[string[first]] + first - words.first[string[first]]
                found = np.stack([doc[string[first]], begin, begin + last - first + window], axis=1)
        out = np.concatenate([found, repeats.reshape(-1, 3)])
        return pa.table({"id": pa.array(out[:, 0]), "start": pa.array(out[:, 1].astype(np.int32)), "stop": pa.array(out[:, 2].astype(np.int32))})

    return meet


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Word spans (id, start, stop) of documents whose windows also start in a document with a smaller id; they may overlap.

    Null texts have no words; rows with a null id neither repeat others nor are repeated.  Rows that share an id are one
    document as far as ids are compared.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    count = buckets_for(3 * text_size(docs, text_col), BUCKET_BYTES)
    packed = rows.mapInArrow(_cut(count, window), "bucket int, packed binary")
    return packed.groupBy("bucket").applyInArrow(_meet(window), "id long, start int, stop int")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of docs with `text_col` reduced to the words that no repeated span covers, joined by one space.

    Adds `n_words` (before) and `n_removed`, in the place of columns of these names.  A null text gives an empty one.
    """
    spans = repeated_spans(docs, id_col, text_col, window).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    both = rows.join(spans.hint("shuffle_hash"), "id", "left").select(*[f"k{i}" for i in range(len(kept))], "text", "spans.start", "spans.stop")
    names = [f"k{i}" for i in range(len(kept))]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text"):
            texts, before, removed = [], [], []
            for text, starts, stops in zip(batch["text"].cast(pa.large_binary()), batch["start"], batch["stop"]):
                words = (text.as_py() or b"").split()
                before.append(len(words))
                gone = 0
                if starts.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, starts.values.to_numpy(), 1)
                    np.add.at(edges, stops.values.to_numpy(), -1)
                    keep = np.cumsum(edges[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = [word for word, stays in zip(words, keep.tolist()) if stays]
                removed.append(gone)
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64())],
                                             [*names, "text", "n_words", "n_removed"])

    out = both.mapInArrow(remove, both.schema[: len(names)].add("text", "string").add("n_words", "long").add("n_removed", "long"))
    back = {c: F.col(n).alias(c) for c, n in zip(kept, names)} | {text_col: F.col("text").alias(text_col)}
    return out.select(*[back[c] for c in docs.columns if c in back], "n_words", "n_removed")
