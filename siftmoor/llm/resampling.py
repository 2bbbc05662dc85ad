"""Importance resampling of documents towards a target set, over hashed word n-grams.

The features of a text are all its runs of 1 to 3 words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS.
How much likelier a bucket is among the targets than among the documents is its gain; a document weighs the sum of its gains, and
the highest weights with Gumbel noise from a hash of the id are drawn, which is a draw without replacement by importance.

A CRC goes on where it ended: the state of "a b" follows from that of "a" and that of " b".  The head of the vocabulary, the
words with HEAD_SHARE of all words and the pairs with HEAD_SHARE of all pairs, is broadcast with its exact states; by their
definition these are at most 1 / HEAD_SHARE words and as many pairs, at any size of the corpus.  Runs of head words take all
states by table; a run with any other word takes the CRC of its bytes.  Both feed the same totals, so the head only saves time:
no result depends on what it holds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import stage, sum_vectors

BUCKETS = 10_000
HEAD_SHARE = 2.0**-14
HEAD_BYTES = 32
LEAST_WORDS = 20
_SCORES = ("n_features", "weight", "score", "rank")


def shift_tables(longest: int) -> np.ndarray:
    """Tables that move a CRC state on over zero bytes: [length, place of the state's byte, the byte's value]."""
    out = np.empty((longest + 1, 4, 256), np.uint32)
    for length in range(longest + 1):
        zeros = bytes(length)
        base = zlib.crc32(zeros)
        for place in range(4):
            # A CRC is linear in its state, so the 256 values of a byte are sums of those of its eight bits.
            bits = [zlib.crc32(zeros, 1 << (8 * place + bit)) ^ base for bit in range(8)]
            row = out[length, place]
            row[0] = 0
            for bit in range(8):
                row[1 << bit : 2 << bit] = row[: 1 << bit] ^ np.uint32(bits[bit])
    return out


class Head:
    """The frequent words with their CRC states, and the states of frequent pairs of them."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        words = [x for x in words if len(x) <= HEAD_BYTES]
        at = {x: i for i, x in enumerate(words)}
        self.words = pa.array(words, pa.binary())
        self.first = np.array([zlib.crc32(x) for x in words], np.uint32)
        self.next = np.array([zlib.crc32(b" " + x) for x in words], np.uint32)
        self.size = np.array([len(x) + 1 for x in words], np.int64)
        known = {at[a] * len(words) + at[b]: zlib.crc32(a + b" " + b) for a, b in pairs if a in at and b in at}
        self.pairs = np.array(sorted(known), np.int64)
        self.pair_state = np.array([known[k] for k in sorted(known)], np.uint32)
        self.shift = shift_tables(HEAD_BYTES + 1)

    def followed(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States after a space and the head words `word`."""
        size = self.size[word]
        moved = self.next[word].copy()
        for place in range(4):
            moved ^= self.shift[size, place, (state >> np.uint32(8 * place)) & np.uint32(255)]
        return moved

    def paired(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """States of pairs of head words: of frequent pairs by table, of others from the words' states."""
        code = one * len(self.words) + other
        at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        hit = self.pairs[at] == code if len(self.pairs) else np.zeros(len(code), bool)
        out = np.empty(len(code), np.uint32)
        out[hit] = self.pair_state[at[hit]]
        out[~hit] = self.followed(self.first[one[~hit]], other[~hit])
        return out


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of a column of texts as codes, the distinct words in the order of the codes, and each text's first word."""
    found = w.text_words(column, w.not_alphanumeric(), True)
    sizes = found.ends - found.starts
    data = found.data[~w.not_alphanumeric()[found.data]]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.binary()), found.first


def _within(first: np.ndarray, count: int, length: int) -> np.ndarray:
    """True where a run of `length` words that starts here ends in the same text."""
    inside = np.ones(count, bool)
    for back in range(1, length):
        ends = first[1:] - back
        inside[ends[ends >= first[:-1]]] = False
    return inside


def feature_buckets(column: pa.Array, head: Head, buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Buckets of runs of 1, 2 and 3 words, the words where these runs start, and each text's first word."""
    codes, words, first = _coded(column)
    place = pc.fill_null(pc.index_in(words, value_set=head.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    state = np.zeros(len(words), np.uint32)
    state[place >= 0] = head.first[place[place >= 0]]
    plain = words.to_pylist()
    tail = np.flatnonzero(place < 0)
    state[tail] = list(map(zlib.crc32, map(plain.__getitem__, tail.tolist())))
    spaced = np.empty(len(plain), object)
    spaced[:] = [b" " + x for x in plain]
    before, place = state[codes], place[codes]
    known, starts = place >= 0, np.arange(len(codes))
    found, runs = [(before % np.uint32(buckets)).astype(np.int64)], [starts]
    for length in (2, 3):
        ok = _within(first, len(codes), length)
        ok[max(0, len(ok) - length + 1) :] = False
        starts = np.flatnonzero(ok)
        last = starts + length - 1
        byhead = known[last] & known[starts] & known[starts + length - 2]
        after = np.empty(len(starts), np.uint32)
        at, to = starts[byhead], last[byhead]
        after[byhead] = head.paired(place[at], place[to]) if length == 2 else head.followed(before[at], place[to])
        rest = np.flatnonzero(~byhead)
        after[rest] = list(map(zlib.crc32, spaced[codes[last[rest]]].tolist(), before[starts[rest]].tolist()))
        found.append((after % np.uint32(buckets)).astype(np.int64))
        runs.append(starts)
        states = np.zeros(len(codes), np.uint32)
        states[starts] = after
        before = states
    return found, runs, first


def head_vocabulary(docs: DataFrame, text_col: str = "text", share: float = HEAD_SHARE) -> Head:
    """The words and pairs whose counts reach `share`; counts under a quarter of the share within a slice of texts are left
    out of the sum, which can only make the head smaller."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text"):
            codes, words, first = _coded(batch["text"])
            least = max(2, int(len(codes) * share / 4))
            counts = np.bincount(codes, minlength=len(words))
            often = np.flatnonzero(counts >= least)
            ok = _within(first, len(codes), 2)
            ok[-1:] = False
            starts = np.flatnonzero(ok)
            starts = starts[(counts[codes[starts]] >= least) & (counts[codes[starts + 1]] >= least)]
            pairs, times = np.unique(codes[starts] * max(1, len(words)) + codes[starts + 1], return_counts=True)
            pairs, times = pairs[times >= least], times[times >= least]
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([none, words.take(pa.array(often)), words.take(pa.array(pairs // max(1, len(words))))]),
                 pa.concat_arrays([none, pa.nulls(len(often), pa.binary()), words.take(pa.array(pairs % max(1, len(words))))]),
                 pa.array(np.concatenate([[len(codes)], counts[often], times]).astype(np.int64))], ["word", "after", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, after binary, n long")
    counts = stage(rows.groupBy("word", "after").agg(F.sum("n").alias("n")), "vocabulary")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("word").isNotNull() & (F.col("n") >= math.ceil(total * share))).collect()
    return Head(sorted(bytes(r.word) for r in often if r.after is None), sorted((bytes(r.word), bytes(r.after)) for r in often if r.after is not None))


def bucket_totals(docs: DataFrame, head: Head, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in w.slices(batches, "text"):
            for found in feature_buckets(batch["text"], head, buckets)[0]:
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "vector"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "piece int, vector binary")
    return sum_vectors(parts, np.int64).get(0, np.zeros(buckets, np.int64))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is among the targets, one added to every count."""
    s_all, t_all, size = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    part = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((part + 0.5) / 4294967296)))


def scored(docs: DataFrame, head: Head, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text"):
            found, runs, first = feature_buckets(batch["text"], head, len(gains))
            upto = np.zeros(first[-1] + 1, np.int64)
            for buckets, starts in zip(found, runs):
                upto[starts + 1] += gains[buckets]
            upto = np.cumsum(upto)
            weight, n = upto[first[1:]] - upto[first[:-1]], np.diff(first)
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            score = weight + np.fromiter(map(noise, batch["id"].to_pylist()), np.int64, len(n))
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(x.astype(np.int64)) for x in (n, features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(rows: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS) -> DataFrame:
    """`rank` for the `percent` highest scores among rows of `least_words` words, from 1; null for all others.

    Rows are sorted in ranges of scores and ids; the rank is the place within the range and the rows of the ranges before, of
    which there are as many numbers as ranges.  Ties go to the smaller id, null ids last; rows that repeat an id stand side by
    side, by weight.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    enough = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    inside = rows.where(enough).repartitionByRange(*order).sortWithinPartitions(*order)
    inside = stage(inside.withColumn("place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("place", 33)
    ranges = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.expr(f"sum(n) OVER () * {int(percent)} div 100").alias("most"))
    ranked = inside.join(F.broadcast(ranges), part == F.col("part")).withColumn("rank", F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("rank") <= F.col("most"), F.col("rank")).alias("rank")).union(
        rows.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs, drawn towards the texts of `target`.

    A null or empty text has no features and weight 0, and is never drawn where `least_words` is above 0.  A null id has noise of
    its own and goes last among equal scores.  Rows that repeat an id are rows of their own with equal noise.  An empty target
    leaves weights that favour rare features; an empty docs gives no row.  Other columns of either table play no part.
    """
    head = head_vocabulary(docs, text_col)
    gains = bucket_gains(bucket_totals(docs, head, text_col), bucket_totals(target, head, text_col))
    return drawn(stage(scored(docs, head, gains, id_col, text_col), "scores"), percent, least_words)
