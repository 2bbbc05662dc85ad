"""Language-model scores by a probabilistic suffix tree over words.

The root predicts each word by its count over the whole corpus, add-one smoothed.  Contexts of up to `depth` words that occur
twice or more become states if their next-word distribution diverges from that of their longest proper suffix by
LEAST_DIVERGENCE bits.  A state adds all its next words' counts to SMOOTHING times the suffix's distribution, so every
distribution sums to one.  A word is scored by the longest suffix state.

With p the suffix's probability of a word, a state of N occurrences, n of them before the word, gives it
(n + SMOOTHING * p) / (N + SMOOTHING).  Over p that is SMOOTHING / (N + SMOOTHING), a value of the state alone, times
1 + n / (SMOOTHING * p), a value of the state and the word: the logarithm of a text is a sum of values of its runs of words.
So all counts and values stay in hash buckets at any size.  Texts to score meet them there; only the values of the most
frequent runs (CACHE_SHARE of all tokens) also go to the tasks, which saves their way but changes nothing.

A run of words is known by its prefix, the run without the last word, and its suffix, the run without the first.  A run of up to
three symbols, the SYMBOLS most frequent words, has its symbols as its code and travels as the difference to the one before it;
other runs have hashes.
Counting is one pass per depth: each task counts its distinct runs, packed by hash bucket, and a bucket is summed in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import buckets_for, shuffles_dropped, stage, text_size

LEAST_COUNT = 2
SYMBOLS, CACHE_SHARE = 1 << 20, 2.0**-21  # of what also goes to the tasks
SHOWN_SHARE, SHOWN_WORDS = 2.0**-12, 256  # of the states that Tree shows
LEAST_DIVERGENCE = 0.05
SMOOTHING = 16.0
DEPTH = 2
BUCKET_BYTES, SLICE_BYTES = 12 << 20, 2 << 20
MERGED_CODES = 1 << 22
MERGED_RUNS = 1 << 19
END = np.uint64(0x454E44)
MARK_BITS, PIECE_BITS = 27, 20  # of the marks of repeated runs, and of a piece of them
_BITS = 21  # of a symbol
_SYMBOL, _LAST, _HASHED = np.uint64(_BITS), np.uint64((1 << _BITS) - 1), np.uint64(1 << 63)
_LONGEST = np.uint64(1 << 2 * _BITS)  # a code below has room for one more symbol
_CODES = "bucket int, codes binary, counts binary"
_RUNS = "bucket int, plain binary, prefix binary, suffix binary, counts binary, told binary"
_LEVEL = "codes binary, counts binary, told binary, values binary, states binary, totals binary, rests binary, shown binary"


class Symbols:
    """Hashes of frequent words; `places` has their ranks by frequency, -1 for others, entering by their leading bits."""

    def __init__(self, ended: np.ndarray, first: np.ndarray, rank: np.ndarray):
        self.hashes, self.ended, self.first, self.rank = ended[:-1], ended, first, rank
        self.shift = np.uint64(65 - len(first).bit_length())

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray) -> Symbols:
        """Of distinct hashes in ascending order."""
        rank = np.empty(len(hashes), np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(hashes))
        bits = max(1, len(hashes).bit_length())
        first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        return Symbols(np.append(hashes, np.uint64(2**64 - 1)), first, rank)

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What tasks get: plain arrays, as executors need no copy of the package."""
        return self.ended, self.first, self.rank

    def places(self, hashes: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        at, wanted = self.first[hashes >> self.shift], hashes
        while len(open_):
            near = self.ended[at]
            hit = (near == wanted) & (at < len(self.hashes))
            out[open_[hit]] = self.rank[at[hit]]
            on = near < wanted
            open_, at, wanted = open_[on], at[on] + 1, wanted[on]
        return out


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text closed by END, and the index of each token's text."""
    words = w.text_words(column, w.spaces(), True)
    hashes = words.hashes()
    return np.insert(hashes, words.first[1:], END), np.repeat(np.arange(len(column)), words.counts + 1)


def _word_codes(symbols: Symbols, hashes: np.ndarray) -> np.ndarray:
    """Symbols by their places from 1 on, other words by their hashes, with the highest bit set."""
    places = symbols.places(hashes)
    return np.where(places >= 0, (places + 1).astype(np.uint64), hashes | _HASHED)


def _code(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The code of runs, from those of the run without its last and without its first word."""
    plain = (prefix < _LONGEST) & (suffix < _HASHED)
    hashed = w.mixed(prefix * np.uint64(0x9E3779B97F4A7C15) + suffix * np.uint64(0xC2B2AE3D27D4EB4F)) | _HASHED
    return np.where(plain, prefix << _SYMBOL | suffix & _LAST, hashed)


def _packed(codes: np.ndarray) -> bytes:
    """Ascending codes as differences, their bytes apart, so that the high ones, mostly zero, compress."""
    return np.diff(codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _short(data: bytes) -> bytes:
    """Compressed, if that is shorter."""
    found = pa.compress(data, "zstd", asbytes=True)
    return found if len(found) < len(data) else data


def _whole(data: bytes, size: int) -> bytes | pa.Buffer:
    return data if len(data) == size else pa.decompress(data, size, "zstd")


def _places_packed(at: np.ndarray) -> bytes:
    """Numbers below 2^16 and how many they are; the low bytes hardly compress and stay as they are."""
    low, high = at.astype(np.uint16).view(np.uint8).reshape(-1, 2).T
    return len(at).to_bytes(4, "little") + low.tobytes() + _short(high.tobytes())


def _places_unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    low, high = np.frombuffer(data, np.uint8, size, 4), np.frombuffer(_whole(data[4 + size :], size), np.uint8)
    return low.astype(np.int64) | high.astype(np.int64) << 8


def _marked(marks: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """False for codes that certainly were not marked."""
    at = w.mixed(codes) >> np.uint64(65 - (8 * len(marks)).bit_length())
    return (marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _marks(level: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of each run that occurs LEAST_COUNT times or more: a longer run that begins with another has no state.

    The bits are of a fixed number; too few of them let more runs through, which changes no result.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch["codes"], batch["counts"]):
                codes = _unpacked(codes.as_py())[np.frombuffer(counts.as_buffer(), np.int32) >= LEAST_COUNT]
                at = np.unique(w.mixed(codes) >> np.uint64(64 - bits))
                edges = np.searchsorted(at, np.arange((1 << max(0, bits - PIECE_BITS)) + 1, dtype=np.uint64) << np.uint64(PIECE_BITS))
                full = np.flatnonzero(np.diff(edges)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), w.binary([at[edges[i] : edges[i + 1]].astype(np.uint32) for i in full])], ["piece", "marks"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        piece = np.zeros(1 << min(bits, PIECE_BITS), bool)
        piece[w.joined(table["marks"], np.uint32) & np.uint32((1 << PIECE_BITS) - 1)] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "marks": w.binary([np.packbits(piece, bitorder="little")])})

    dealt = level.select("codes", "counts").mapInArrow(deal, "piece int, marks binary")
    out, size = np.zeros((1 << bits) // 8, np.uint8), (1 << min(bits, PIECE_BITS)) // 8
    for row in dealt.groupBy("piece").applyInArrow(join, "piece int, marks binary").collect():
        out[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.marks, np.uint8)
    return out


def _run_codes(tokens: np.ndarray, text: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to depth + 1 words, the places of their last words and their codes; runs stay within a text."""
    out, codes, starts = [(np.arange(len(tokens)), tokens)], tokens, np.append(True, text[1:] != text[:-1])[: len(tokens)]
    since = np.arange(len(tokens)) - np.maximum.accumulate(np.where(starts, np.arange(len(tokens)), 0))
    for length in range(1, depth + 1):
        codes = np.concatenate([codes[:1], _code(codes[:-1], codes[1:])])
        at = np.flatnonzero(since >= length)
        out.append((at, codes[at]))
    return out


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    opens = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[opens], np.add.reduceat(counts, opens) if len(opens) else counts


def _counted(rows: DataFrame, codes_of: Callable[[pa.Array], np.ndarray], buckets: int) -> DataFrame:
    """How often each code occurs: one row of sorted codes and their counts per bucket."""

    def emit(parts: list) -> pa.RecordBatch:
        codes, counts = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        order, upto = w.by_bucket(w.mixed(codes) % np.uint64(buckets), buckets)
        codes, counts, full = codes[order], counts[order].astype(np.int32), np.flatnonzero(np.diff(upto))
        cut = lambda x: pa.array([x[upto[b] : upto[b + 1]].tobytes() for b in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(codes), cut(counts)], ["bucket", "codes", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in w.slices(batches, "text", SLICE_BYTES):
            codes, counts = np.unique(codes_of(batch["text"]), return_counts=True)
            parts, held = [*parts, (codes, counts)], held + len(codes)
            if held > MERGED_CODES:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        codes, counts = _sums(w.joined(table["codes"], np.uint64), w.joined(table["counts"], np.int32).astype(np.int64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "codes": w.binary([codes]), "counts": w.binary([counts])})

    return stage(rows.select("text").mapInArrow(count, _CODES).groupBy("bucket").applyInArrow(add, _CODES), "counts", drop_shuffles=True, large_rows=True)


def _frequent(counted: DataFrame, enough: Callable[[np.ndarray], np.ndarray | float]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes whose count reaches `enough` of the code; the shares that callers ask for bound their number."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch["codes"], batch["counts"]):
                codes, counts = np.frombuffer(codes.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                good = counts >= enough(codes)
                yield pa.RecordBatch.from_arrays([w.binary([codes[good]]), w.binary([counts[good]])], ["codes", "counts"])

    rows = counted.mapInArrow(pick, "codes binary, counts binary").collect()
    codes, counts = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in enumerate((np.uint64, np.int64)))
    order = np.argsort(codes)
    return codes[order], counts[order]


def _least_count(counted: DataFrame, most: int) -> float:
    """A count that at most `most` codes reach: the least edge of eighths of a power of two that does."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch["counts"]:
                found, many = np.unique(np.floor(8 * np.log2(np.frombuffer(counts.as_buffer(), np.int64))).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(many.astype(np.int64))], ["bin", "many"])

    rows = sorted((r.bin, r.many) for r in counted.select("counts").mapInArrow(bins, "bin long, many long").groupBy("bin").agg(F.sum("many").alias("many")).collect())
    while rows and sum(many for _, many in rows) > most:
        rows = rows[1:]
    return 2.0 ** (rows[0][0] / 8) if rows else np.inf


def _find(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted code, -1 for those that are not there."""
    if not len(codes):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


class Level:
    """Frequent states of one depth: their codes (state of the depth before, last symbol), suffixes, kept flags and next words."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, suffix: np.ndarray):
        self.codes, self.counts, self.suffix = codes, counts, suffix
        self.kept = np.zeros(len(codes), bool)
        self.rest = np.zeros(len(codes))
        self.next, self.gain = np.zeros(0, np.uint64), np.zeros(0)


class Tree:
    """What is at hand of the model: symbols with their counts, the number of tokens and distinct tokens, the values of frequent
    runs, the staged values of all runs, and, to look at, the levels: states with SHOWN_SHARE of all tokens and at most
    SHOWN_WORDS next words."""

    def __init__(self, symbols: Symbols, counts: np.ndarray, tokens: int, distinct: int):
        self.symbols, self.counts, self.tokens, self.distinct = symbols, counts, tokens, distinct
        self.levels: list[Level] = []
        self.depth, self.values = 0, []
        self.shared: Broadcast | None = None  # the symbols' parts
        self.marks: list[Broadcast] = []  # of runs of two words and more
        self.cached, self.cached_values = np.zeros(0, np.uint64), np.zeros(0)

    def base(self, symbols: np.ndarray) -> np.ndarray:
        """The root's log10 probability of symbols."""
        return np.log10(self.counts[symbols] + 1.0) - np.log10(self.tokens + self.distinct + 1.0)

    def gains(self, states: list[np.ndarray], following: np.ndarray) -> np.ndarray:
        """log10 of the longest state's probability of the following symbol (-1: none of them) over the root's."""
        total = np.zeros(len(following))
        for level, state in zip(self.levels, states):
            at = np.flatnonzero(state >= 0)
            at = at[level.kept[state[at]]]
            place = _find(level.next, state[at].astype(np.uint64) << _SYMBOL | np.maximum(following[at], 0).astype(np.uint64))
            place[following[at] < 0] = -1
            total[at] = np.where(place >= 0, level.gain[place] if len(level.gain) else 0.0, level.rest[state[at]] + total[at])
        return total

    def chain(self, depth: int, state: np.ndarray) -> list[np.ndarray]:
        """The states of all suffixes of states of a depth, from depth 0 on."""
        out = [state]
        for level in reversed(self.levels[1 : depth + 1]):
            out.append(level.suffix[out[-1]])
        return out[::-1]

    def show(self, prefix: np.ndarray, suffix: np.ndarray, counts: np.ndarray, told: np.ndarray, kept: np.ndarray) -> None:
        """A level of states, all of whose runs are given; states with words or suffixes that are not shown are left out."""
        above = self.levels[-1] if self.levels else None
        if above is None:
            state, symbol = prefix, np.where(suffix < _HASHED, suffix, np.uint64(0)).astype(np.int64) - 1
            whole = ~np.isin(prefix, prefix[(symbol < 0) | (prefix >= _HASHED)])
            hashes = np.unique(prefix[whole])
            code, back = hashes - np.uint64(1), np.zeros(len(hashes), np.int64)
        else:
            run = _find(above.runs, suffix)
            whole = (run >= 0) & (_find(above.runs, prefix) >= 0)
            whole = ~np.isin(prefix, prefix[~whole])
            state, symbol = prefix, np.where(run >= 0, (above.next[above.by_run[run]] & _LAST).astype(np.int64) if len(above.runs) else -1, -1)
            hashes, first = np.unique(prefix[whole], return_index=True)
            code = above.next[above.by_run[_find(above.runs, hashes)]] if len(hashes) else np.zeros(0, np.uint64)
            back = (above.next[above.by_run[run[whole][first]]] >> _SYMBOL).astype(np.int64) if len(hashes) else np.zeros(0, np.int64)
        order = np.argsort(code)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[np.searchsorted(hashes, state[whole])]
        symbol, counts, told, suffix, prefix = symbol[whole], counts[whole], told[whole], suffix[whole], prefix[whole]
        level = Level(code[order], np.bincount(at, counts, len(order)).astype(np.int64), back[order])
        level.kept[at] = kept[whole]
        level.rest = np.log10(SMOOTHING / (level.counts + SMOOTHING))
        following = at.astype(np.uint64) << _SYMBOL | symbol.astype(np.uint64)
        order = np.argsort(following)
        level.next, level.gain = following[order], told[order] - self.base(symbol[order])
        runs = _code(prefix, suffix)[order]
        level.by_run = np.argsort(runs)
        level.runs = runs[level.by_run]
        self.levels.append(level)


def _dealt(keys: np.ndarray, buckets: int, schema: pa.Schema, **columns: np.ndarray) -> pa.Table:
    """A row of packed columns for each bucket of the keys."""
    order, upto = w.by_bucket(w.mixed(keys) % np.uint64(buckets), buckets)
    full = np.flatnonzero(np.diff(upto)).tolist()
    dealt = {n: x[order] for n, x in columns.items()}
    found = {n: pa.array([x[upto[b] : upto[b + 1]].tobytes() for b in full], pa.binary()) for n, x in dealt.items()}
    return pa.table([pa.array(full, f.type) if f.name == "bucket" else found.get(f.name, pa.nulls(len(full), f.type)) for f in schema], schema)


def _dealt_runs(by: np.ndarray, buckets: int, prefix: np.ndarray, suffix: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Runs, ascending by their codes, in rows of a bucket each; those of symbols (`plain`) are the first."""
    codes = _code(prefix, suffix)
    order, upto = w.by_bucket(w.mixed(by) % np.uint64(buckets), buckets)
    codes, prefix, suffix = codes[order], prefix[order], suffix[order]
    full = np.flatnonzero(np.diff(upto))
    edges = np.append(upto[full], len(codes)).tolist()
    middle = [a + int(np.searchsorted(codes[a:b], _HASHED)) for a, b in zip(edges[:-1], edges[1:])]
    found = {"plain": [_packed(codes[a:m]) for a, m in zip(edges[:-1], middle)], "prefix": [prefix[m:b].tobytes() for m, b in zip(middle, edges[1:])],
             "suffix": [suffix[m:b].tobytes() for m, b in zip(middle, edges[1:])]}
    for name, x in columns.items():
        x = x[order]
        found[name] = [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.table([pa.array(full, f.type) if f.name == "bucket" else pa.array(found[f.name], f.type) if f.name in found else pa.nulls(len(full), f.type) for f in _RUNS_ARROW], _RUNS_ARROW)


def _runs_in(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes and suffixes of runs of length + 1 words, in the order of the other columns."""
    prefix, suffix, rest = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.uint64((1 << min(_BITS * length, 63)) - 1)
    for row in zip(table["plain"], table["prefix"], table["suffix"]):
        codes = _unpacked(row[0].as_py())
        prefix += [codes >> _SYMBOL, np.frombuffer(row[1].as_buffer(), np.uint64)]
        suffix += [codes & rest, np.frombuffer(row[2].as_buffer(), np.uint64)]
    return np.concatenate(prefix), np.concatenate(suffix)


_RUNS_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.binary()) for c in _RUNS.split(", ")])


def _runs_of(rows: DataFrame, length: int, symbols: Broadcast, marks: Broadcast | None, buckets: int) -> DataFrame:
    """How often each run of length + 1 words occurs, dealt by its suffix; a run may be in several rows.

    Runs whose prefix is not marked are left out: it occurs once and is no state.
    """

    def emit(parts: list) -> list:
        prefix, suffix, counts = (np.concatenate(x) for x in zip(*parts))
        prefix, suffix, counts = _merged(prefix, suffix, counts)
        return _dealt_runs(suffix, buckets, prefix, suffix, counts=counts).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in w.slices(batches, "text", SLICE_BYTES):
            tokens, text = _tokens(batch["text"])
            at, codes = _run_codes(_word_codes(Symbols(*symbols.value), tokens), text, length - 1)[-1]
            follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (text[at[1:]] == text[at[:-1]])) if len(at) else np.zeros(0, np.int64)
            if marks is not None:
                follows = follows[_marked(marks.value, codes[follows])]
            part = codes[follows], codes[follows + 1], np.ones(len(follows), np.int64)
            parts.append(part if marks is not None else _merged(*part))  # few longer runs are equal within a slice
            held += len(parts[-1][0])
            if held > MERGED_RUNS:
                yield from emit(parts)
                parts, held = [], 0
        if parts:
            yield from emit(parts)

    return rows.mapInArrow(count, _RUNS)


def _merged(prefix: np.ndarray, suffix: np.ndarray, counts: np.ndarray) -> tuple:
    """Equal runs once, with their counts summed, in order of their codes."""
    codes = _code(prefix, suffix)
    order = np.argsort(codes)
    codes = codes[order]
    opens = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    first = order[opens]
    return prefix[first], suffix[first], np.add.reduceat(counts[order], opens) if len(opens) else counts


def _level(rows: DataFrame, length: int, symbols: Broadcast, marks: Broadcast | None, before: DataFrame, told_of: Callable[[pa.RecordBatch], Iterator[tuple]], buckets: int,
           least_shown: float, last: bool) -> DataFrame:
    """The states of contexts of `length` words, staged: told probabilities (log10) of all runs, values of runs and states.

    told_of: gives ascending codes and told values of the runs of `length` words from batches of `before`.  It is a step of `deal`,
    not a `mapInArrow` of its own: a task has a Python worker for each, and workers stay with the memory that they took.
    Nothing is told of the `last` level, which has no longer runs.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, told in told_of(batch):
                yield from _dealt(codes, buckets, _RUNS_ARROW, suffix=codes, told=told).to_batches()

    def attach(key: tuple, table: pa.Table) -> pa.Table:
        known = table["told"].is_valid()
        by, runs = table.filter(known), table.filter(pa.compute.invert(known))
        codes, told = w.joined(by["suffix"], np.uint64), w.joined(by["told"], np.float32)
        order = np.argsort(codes)
        (prefix, suffix), counts = _runs_in(runs, length), w.joined(runs["counts"], np.int64)
        prefix, suffix, counts = _merged(prefix, suffix, counts)
        place = _find(codes[order], suffix)
        good = place >= 0  # a suffix without a state is missing, and then the prefix has none either
        return _dealt_runs(prefix[good], buckets, prefix[good], suffix[good], counts=counts[good], told=told[order][place[good]])

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        (prefix, suffix), counts, before = _runs_in(table, length), w.joined(table["counts"], np.int64), w.joined(table["told"], np.float32).astype(np.float64)
        states, state = np.unique(prefix, return_inverse=True)
        often = np.bincount(state, counts, len(states)) >= LEAST_COUNT
        good = np.flatnonzero(often[state])
        order = good[np.argsort(_code(prefix[good], suffix[good]))]
        prefix, suffix, counts, before = prefix[order], suffix[order], counts[order], before[order]
        states, state = states[often], (np.cumsum(often) - 1)[state[order]]
        totals = np.bincount(state, counts, len(states))
        told = np.log10(counts + SMOOTHING * 10**before) - np.log10(totals[state] + SMOOTHING)
        rest = np.log10(SMOOTHING / (totals + SMOOTHING))
        left = np.clip(1 - np.bincount(state, 10**told, len(states)), 0, None)
        divergence = (np.bincount(state, 10**told * (told - before), len(states)) + left * rest) / np.log10(2)
        kept = divergence >= LEAST_DIVERGENCE
        values = np.where(kept[state], told - before - rest[state], 0.0)
        shown = (totals >= least_shown) & (np.bincount(state, minlength=len(states)) <= SHOWN_WORDS)
        shown = np.flatnonzero(shown[state])
        sample = pa.table({"prefix": prefix[shown], "suffix": suffix[shown], "counts": counts[shown], "told": told[shown], "kept": kept[state[shown]]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, sample.schema) as stream:
            stream.write_table(sample)
        fewer = lambda x: np.minimum(x, 2**31 - 1).astype(np.int32)  # noqa: E731, only compared with small counts
        columns = {"counts": fewer(counts), "told": np.where(kept[state], told, before).astype(np.float32)[: 0 if last else None], "values": values.astype(np.float32),
                   "totals": fewer(totals[kept]), "rests": rest[kept].astype(np.float32)}
        columns = {n: x.tobytes() for n, x in columns.items()} | {"codes": _packed(_code(prefix, suffix)), "states": _packed(states[kept])}
        names = [c.split()[0] for c in _LEVEL.split(", ")][:-1]
        return pa.table({n: pa.array([columns[n]], pa.binary()) for n in names} | {"shown": pa.array([sink.getvalue().to_pybytes() if len(shown) else None], pa.binary())})

    met = _runs_of(rows, length, symbols, marks, buckets).union(before.mapInArrow(deal, _RUNS)).groupBy("bucket").applyInArrow(attach, _RUNS)
    return stage(met.groupBy("bucket").applyInArrow(decide, _LEVEL), "level", drop_shuffles=True, large_rows=True)


def fit(docs: DataFrame, text: str = "text", depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree of the texts of `docs` and the staged counts of all their tokens.  A null text counts as empty."""
    with shuffles_dropped(docs.sparkSession):
        return _fit(docs, text, depth)


def _fit(docs: DataFrame, text: str, depth: int) -> tuple[Tree, DataFrame]:
    rows = docs.select(F.col(text).alias("text"))
    buckets = buckets_for(text_size(docs, text) // 2, BUCKET_BYTES)
    counted = _counted(rows, lambda column: _tokens(column)[0], buckets)
    totals = counted.select(F.octet_length("codes").alias("bytes"), "counts").mapInArrow(_totals, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, distinct = totals[0] or 0, totals[1] or 0
    least = _least_count(counted, SYMBOLS)
    hashes, counts = _frequent(counted, lambda codes: least)
    tree = Tree(Symbols.of(hashes, counts), -np.sort(-counts), tokens, distinct)
    if not tokens:
        return tree, counted
    context = docs.sparkSession.sparkContext
    whole, symbols = float(np.log10(tokens + distinct + 1.0)), context.broadcast(tree.symbols.parts)
    tree.shared = symbols

    def base(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for codes, counts in zip(batch["codes"], batch["counts"]):
            codes, told = _word_codes(Symbols(*symbols.value), np.frombuffer(codes.as_buffer(), np.uint64)), np.log10(np.frombuffer(counts.as_buffer(), np.int64) + 1.0) - whole
            order = np.argsort(codes)
            yield codes[order], told[order].astype(np.float32)

    bits = min(MARK_BITS, max(3, tokens.bit_length() + 1))
    marks, before, told_of, wide, found = None, counted.select("codes", "counts"), base, max(1.0, CACHE_SHARE * tokens), []
    for length in range(1, depth + 1):
        level = _level(rows, length, symbols, marks, before, told_of, 4 * buckets, max(LEAST_COUNT, SHOWN_SHARE * tokens), length == depth)
        before, told_of, tree.depth = level.select("codes", "told"), _told, length
        if length < depth:
            marks = context.broadcast(_marks(level, bits))
            tree.marks.append(marks)
        for codes, n, values in (("codes", "counts", "values"), ("states", "totals", "rests")):
            part = level.select(F.col(codes).alias("codes"), F.col(n).alias("counts"), F.col(values).alias("values"))
            tree.values.append(part)
            found += part.mapInArrow(_wide(wide), "codes binary, values binary").collect()
        shown = [pa.ipc.open_stream(r.shown).read_all() for r in level.where("shown is not null").select("shown").collect()]
        if shown:
            shown = pa.concat_tables(shown)
            tree.show(*(shown[c].to_numpy() for c in ("prefix", "suffix", "counts", "told", "kept")))
    codes, values = (np.frombuffer(b"".join(r[i] for r in found), k) for i, k in enumerate((np.uint64, np.float64)))
    tree.cached, tree.cached_values = _sums(codes, values)
    return tree, counted


def _told(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for codes, told in zip(batch["codes"], batch["told"]):
        yield _unpacked(codes.as_py()), np.frombuffer(told.as_buffer(), np.float32)


def _wide(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Picks the runs and states that occur so often; a run and its state occur equally often, so both values are there."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts, values in zip(batch["codes"], batch["counts"], batch["values"]):
                good = np.frombuffer(counts.as_buffer(), np.int32) >= least
                found = _unpacked(codes.as_py())[good], np.frombuffer(values.as_buffer(), np.float32)[good].astype(np.float64)
                yield pa.RecordBatch.from_arrays([w.binary([x]) for x in found], ["codes", "values"])

    return pick


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch["counts"]], pa.int64()),
                                          pa.array([x.as_py() // 8 for x in batch["bytes"]], pa.int64())], ["tokens", "words"])


_SLICE = "slice long, rows binary, sizes binary, tokens binary"
_PART = "bucket int, slice long, gains binary, at binary, codes binary, counts binary, runs binary, values binary"
_PART_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64()}.get(c.split()[1], pa.binary())) for c in _PART.split(", ")])


def score(docs: DataFrame, model: tuple[Tree, DataFrame], keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns `keep`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` for every row of docs.

    Words are lower-cased (A-Z) runs of other than spaces and 0x09-0x0D, then one end token; a null text is empty and has the
    end alone.  `base_score` is the root's log10 probability of the text, `score` that of the tree.  Every row gives one row.
    """
    tree, counted = model
    with shuffles_dropped(docs.sparkSession):
        buckets = buckets_for(text_size(docs, text), BUCKET_BYTES)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
    names, kept = list(keep), rows.schema[: len(keep)]
    own = ["n_tokens", "n_known", "sum"]
    schema, depth = _PART_ARROW, tree.depth
    context = docs.sparkSession.sparkContext
    cache, base_counts = context.broadcast((tree.cached, tree.cached_values)), context.broadcast(tree.counts)
    symbols, marks = tree.shared or context.broadcast(tree.symbols.parts), tree.marks
    train_tokens, whole = tree.tokens, np.log10(tree.tokens + tree.distinct + 1.0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, symbols_of, symbol_counts = TaskContext.get().partitionId() << 32, Symbols(*symbols.value), base_counts.value
        for number, batch in enumerate(w.slices(batches, "_text", SLICE_BYTES)):
            tokens, text = _tokens(batch["_text"])
            places, size = symbols_of.places(tokens), batch.num_rows
            head = places >= 0
            found = (np.bincount(text, minlength=size), np.bincount(text[head], minlength=size),
                     np.bincount(text[head], np.log10(symbol_counts[places[head]] + 1.0), size))
            told = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, found)], [*names, *own])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, told.schema) as stream:
                stream.write_batch(told)
            codes = np.where(head, (places + 1).astype(np.uint64), tokens | _HASHED)
            columns = sink.getvalue().to_pybytes(), found[0].astype(np.int32).tobytes(), codes.view(np.uint8).reshape(-1, 8).T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([base | number], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)], [c.split()[0] for c in _SLICE.split(", ")])

    def dealt(number: int, keys: np.ndarray, at: np.ndarray, name: str, packed: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
        """Ascending keys of a slice with their texts, dealt to the buckets."""
        order, upto = w.by_bucket(w.mixed(keys) % np.uint64(buckets), buckets)
        keys, at, full = keys[order], at[order], np.flatnonzero(np.diff(upto)).tolist()
        asked = [{"bucket": b, "slice": number, name: packed(keys[upto[b] : upto[b + 1]]),
                  "at": _places_packed(at[upto[b] : upto[b + 1]])} for b in full]
        return pa.Table.from_pylist(asked, schema).to_batches()

    def asks(lengths: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Words that are no symbols and runs of these lengths that are not cached; values of cached ones are summed at once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cached, values = cache.value
            for batch in batches:
                for number, sizes, tokens in zip(batch["slice"].to_pylist(), batch["sizes"], batch["tokens"]):
                    sizes = np.frombuffer(sizes.as_buffer(), np.int32)
                    tokens = np.frombuffer(tokens.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
                    text, found = np.repeat(np.arange(len(sizes)), sizes), []
                    if lengths[0] == 1:
                        rare = np.flatnonzero(tokens >= _HASHED)
                        rare = rare[np.argsort(tokens[rare])]
                        yield from dealt(number, tokens[rare], text[rare], "codes", np.ndarray.tobytes)
                    runs = _run_codes(tokens, text, lengths[-1] - 1) if depth else []
                    for length, (at, codes) in enumerate(runs, 1):
                        if length in lengths:
                            if length > 2:
                                before = runs[length - 2]
                                asked = _marked(marks[length - 3].value, before[1][np.searchsorted(before[0], at - 1)])
                                at, codes = at[asked], codes[asked]
                            found.append((codes, text[at]))
                    if not found:
                        continue
                    codes, at = (np.concatenate(x) for x in zip(*found))
                    order = np.argsort(codes)
                    codes, at = codes[order], at[order]
                    place = _find(cached, codes)
                    if len(cached):
                        gains = np.bincount(at, np.where(place >= 0, values[place], 0.0), len(sizes))
                        yield from pa.Table.from_pylist([{"bucket": number % buckets, "slice": number, "gains": gains.tobytes()}], schema).to_batches()
                    yield from dealt(number, codes[place < 0], at[place < 0], "runs", _packed if lengths[-1] < 3 else lambda x: _short(_packed(x)))  # codes of three symbols are long

        return run

    def by_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The values of runs that are not cached, dealt to the buckets of the texts to score."""
        for batch in batches:
            for codes, values in zip(batch["codes"], batch["values"]):
                codes, values = _unpacked(codes.as_py()), np.frombuffer(values.as_buffer(), np.float32)
                told = (values != 0) & (_find(cache.value[0], codes) < 0)
                yield from _dealt(codes[told], buckets, schema, runs=codes[told], values=values[told]).to_batches()

    def by_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of words that are no symbols, dealt to the buckets of the texts to score."""
        for batch in batches:
            for codes, counts in zip(batch["codes"], batch["counts"]):
                codes, counts = np.frombuffer(codes.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                rare = Symbols(*symbols.value).places(codes) < 0
                codes, counts = codes[rare] | _HASHED, counts[rare]
                order, upto = w.by_bucket(w.mixed(codes) % np.uint64(buckets), buckets)
                codes, counts = codes[order], counts[order]
                out = [{"bucket": b, "codes": codes[upto[b] : upto[b + 1]].tobytes(), "counts": counts[upto[b] : upto[b + 1]].tobytes()} for b in np.flatnonzero(np.diff(upto)).tolist()]
                yield from pa.Table.from_pylist(out, schema).to_batches()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        known, valued = table["counts"].is_valid(), table["values"].is_valid()
        words, told = table.filter(known), table.filter(valued)
        codes, counts = _sums(w.joined(words["codes"], np.uint64), w.joined(words["counts"], np.int64))
        runs, values = _sums(w.joined(told["runs"], np.uint64), w.joined(told["values"], np.float32).astype(np.float64))
        out = []
        for row in table.filter(pa.compute.invert(pa.compute.or_(known, valued))).to_pylist():
            if row["gains"] is not None:
                gains = np.frombuffer(row["gains"])
                out.append({"slice": row["slice"], "runs": np.arange(len(gains), dtype=np.uint16).tobytes(), "values": gains.tobytes()})
                continue
            at = _places_unpacked(row["at"])
            asked, among = (_unpacked(_whole(row["runs"], 8 * len(at))), runs) if row["runs"] is not None else (np.frombuffer(row["codes"], np.uint64), codes)
            place = _find(among, asked)
            hit = place >= 0
            at, place = at[hit], place[hit]
            many = np.bincount(at)
            texts = np.flatnonzero(many)
            if row["runs"] is not None:
                out.append({"slice": row["slice"], "runs": texts.astype(np.uint16).tobytes(), "values": np.bincount(at, values[place], len(many))[texts].tobytes()})
                continue
            sums = np.bincount(at, np.log10(counts[place] + 1.0), len(many))[texts]
            out.append({"slice": row["slice"], "at": texts.astype(np.uint16).tobytes(), "counts": many[texts].astype(np.int32).tobytes(), "codes": sums.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([f for f in schema if f.name != "bucket"]))

    def close(key: tuple, table: pa.Table) -> pa.Table:
        told = next(pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["rows"] if x.is_valid)
        tokens, known, total = (told[c].to_numpy().copy() for c in own)
        at = w.joined(table["at"], np.uint16).astype(np.int64)
        known += np.bincount(at, w.joined(table["counts"], np.int32), len(tokens)).astype(np.int64)
        total += np.bincount(at, w.joined(table["codes"], np.float64), len(tokens))
        gain = np.bincount(w.joined(table["runs"], np.uint16).astype(np.int64), w.joined(table["values"], np.float64), len(tokens))
        base = total - tokens * whole
        found = {"n_tokens": tokens, "n_known": known, "train_tokens": np.full(len(tokens), train_tokens, np.int64), "base_score": base, "score": base + gain}
        return pa.table({c: told[c] for c in names} | {c: pa.array(x) for c, x in found.items()})

    # One round for each length of runs, so that the files of one are gone before the next.  The codes of `meet` are sums of logarithms.
    sliced, sums = stage(rows.mapInArrow(cut, _SLICE), "slices", drop_shuffles=True, large_rows=True), None
    for lengths in [(n,) for n in range(1, depth + 2)]:
        parts = sliced.select("slice", "sizes", "tokens").mapInArrow(asks(lengths), _PART)
        if lengths[0] == 1:
            parts = parts.union(counted.select("codes", "counts").mapInArrow(by_words, _PART))
        for place, values in enumerate(tree.values):
            if (place // 2 + 1 if place % 2 else place // 2 + 2) in lengths:  # states of a level have a word less than its runs
                parts = parts.union(values.select("codes", "values").mapInArrow(by_runs, _PART))
        met = stage(parts.groupBy("bucket").applyInArrow(meet, _PART.removeprefix("bucket int, ")), "sums", drop_shuffles=True)
        sums = met if sums is None else sums.union(met)
    met = sums.unionByName(sliced.select("slice", "rows"), allowMissingColumns=True)
    out = kept.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return met.groupBy("slice").applyInArrow(close, out)
