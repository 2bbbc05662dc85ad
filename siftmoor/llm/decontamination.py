"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and passages of documents become TF-IDF vectors over the words of the benchmark, weighted by counts over all
documents.  A randomised SVD, whose products run as Spark jobs over all passages of all documents and all pieces of the items,
gives a latent space, in which words that go together in the corpus are near each other (see `_corpus_space`).  As a space that
is smaller than the pieces confuses some of them, every passage also meets the pieces in the space that they span themselves,
where a cosine is that of the whole vectors (see `_latent`).  Passages near an item by either cosine are compared with it by
longest common subsequence, and by its answer where they only paraphrase it.

Texts are split into words once: they are staged as the places of their words in the benchmark's vocabulary, which the counts,
the products and the search read.

A passage's vector has all its words in its length, also those the benchmark does not have.  The share of the length that
benchmark words make bounds every cosine, and so does the sum of what each word adds to any of them at most, so most passages are
cut, without loss, before they are projected.

Cosines say little about an item whose words are common, be it by nature or because the item itself is in many documents.  So
dense passages are found without weights as well: a stretch of words that has the share VERBATIM of a piece's words in order,
with at most that share of its own length in other words, is always compared (see `Dense`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import stage, sum_vectors

PASSAGE, STRIDE = 64, 32
PIECE_WORDS = 48
PIECES = 256
RANK, EXTRA, ROUNDS = 256, 16, 2
ROWS, OFTEN = 64, 512
LEAST_COSINE = 0.25
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.5, 0.75
ANSWER_WORDS = 6
COMMON_SHARE, COMMON_IDF = 0.05, 0.05
LEAST_CONTENT = 4
DENSE_SHARE = 0.6
WORDS_AT_ONCE = 1 << 17
STRETCHES_AT_ONCE = 1 << 12
_VECTOR_PIECES = 16


def longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word operation per element of b."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = all_set = (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & all_set).bit_count()


class Vocabulary:
    """Sorted hashes of the benchmark's words; `places` finds them, -1 for others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes & np.uint64(0xFFFF)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFF)])
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[near] == hashes[at], near, -1)
        return out


def _passages(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of every passage; they overlap by half and cover the whole text."""
    many = np.where(counts > 0, np.maximum(1, -(-(counts - STRIDE) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), many)
    start = first[:-1][text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    return text, start, np.minimum(start + PASSAGE, first[1:][text])


def _vector(places: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of a passage with their weights: the root of the count times the idf."""
    found, count = np.unique(places[places >= 0], return_counts=True)
    return found, np.sqrt(count) * idf[found]


def _matrix(places: np.ndarray, start: np.ndarray, stop: np.ndarray, idf: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """The vectors of passages (see `_vector`) as rows, ROWS at a time: which ones, their first OFTEN columns, what other columns some have, and those.

    It is made for places in the order of falling counts.
    """
    lengths, size, often = stop - start, max(1, len(idf)), min(OFTEN, len(idf))
    owner = np.repeat(np.arange(len(start)), lengths)
    place = places[np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(owner))]
    pairs, count = np.unique((owner * size + place)[place >= 0], return_counts=True)
    owner, place = np.divmod(pairs, size)
    value = (np.sqrt(count) * idf[place]).astype(np.float32)
    lows = range(0, len(start), ROWS)
    edges = np.searchsorted(owner, [*lows, len(start)]).tolist()
    for low, a, b in zip(lows, edges[:-1], edges[1:]):
        high, row, at, v, head = min(low + ROWS, len(start)), owner[a:b] - low, place[a:b], value[a:b], place[a:b] < often
        frequent = np.zeros((high - low, often), np.float32)
        frequent[row[head], at[head]] = v[head]
        columns, at = np.unique(at[~head], return_inverse=True)
        others = np.zeros((high - low, len(columns)), np.float32)
        others[row[~head], at] = v[~head]
        yield slice(low, high), frequent, columns, others


def _vectors(rows: list[np.ndarray]) -> pa.RecordBatch:
    pieces = [x.tobytes() for v in rows for x in np.array_split(v, _VECTOR_PIECES)]
    return pa.RecordBatch.from_arrays([pa.array(list(range(_VECTOR_PIECES)) * len(rows), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "vector"])


def _summed(rows: DataFrame, kind: str, size: int) -> np.ndarray:
    parts = sum_vectors(rows, kind)
    return np.concatenate([parts[i] for i in sorted(parts)]) if parts else np.zeros(size, kind)


def _coded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The texts of `rows` (id, text) as places of their words in the vocabulary, -1 for others: (id, places), staged."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text"):
            words = w.text_words(batch["text"], w.not_alphanumeric(), True)
            places, first = vocabulary.places(words.hashes()).astype(np.int32), words.first.tolist()
            yield pa.RecordBatch.from_arrays([batch["id"], w.binary([places[a:b] for a, b in zip(first[:-1], first[1:])])], ["id", "places"])

    return stage(rows.mapInArrow(code, "id long, places binary"), "coded")


def _decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words and the index of each text's first word (one more at the end)."""
    places = w.joined(batch["places"], np.int32)
    return places, np.concatenate([[0], np.cumsum(pc.binary_length(batch["places"]).to_numpy(zero_copy_only=False) // places.itemsize)]).astype(np.int64)


def _document_counts(coded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary is, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in w.slices(batches, "places"):
            places, first = _decoded(batch)
            hit = places >= 0
            pairs = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(first))[hit] * max(1, size) + places[hit])
            total[:size] += np.bincount(pairs % max(1, size), minlength=size)[:size]
            total[size] += batch.num_rows
        yield _vectors([total])

    total = _summed(coded.select("places").mapInArrow(count, "piece int, vector binary"), "int64", size + 1)
    return total[:-1], int(total[-1])


def _add_product(places: np.ndarray, first: np.ndarray, idf: np.ndarray, basis: np.ndarray, total: np.ndarray) -> None:
    """Adds X'X basis to `total`; the rows of X are the vectors of the texts' passages, back to back, so that each word counts once."""
    many, often = -(-np.diff(first) // PASSAGE), min(OFTEN, len(idf))
    text = np.repeat(np.arange(len(many)), many)
    start = first[:-1][text] + PASSAGE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    for _, frequent, columns, others in _matrix(places, start, np.minimum(start + PASSAGE, first[1:][text]), idf):
        folded = frequent @ basis[:often] + others @ basis[columns]
        total[:often] += frequent.T @ folded
        total[columns] += others.T @ folded


def _corpus_space(coded: DataFrame, local: np.ndarray, idf: np.ndarray, pieces: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the leading right singular vectors of all passages of all documents and of all pieces.

    By randomised subspace iteration.  `local` tells the place here of each word of the vocabulary of `coded`, -1 for none.
    """
    size = len(idf)
    rank = min(size, RANK + EXTRA)
    own, edges = np.concatenate([np.zeros(0, np.int64), *pieces]), np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
    basis = np.random.default_rng(5).standard_normal((size, rank)).astype(np.float32)
    for _ in range(ROUNDS):

        def multiply(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, rank), np.float32)
            for batch in w.slices(batches, "places"):
                places, first = _decoded(batch)
                _add_product(local[places], first, idf, basis, total)
            yield _vectors([total.ravel()])

        product = _summed(coded.select("places").mapInArrow(multiply, "piece int, vector binary"), "float32", size * rank).reshape(size, rank)
        _add_product(own, edges, idf, basis, product)
        basis = np.linalg.qr(product)[0].astype(np.float32)
    return basis


def _latent(pieces: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal basis of the space of all pieces (places of their words), and the pieces' unit vectors in it, a row each."""
    whole = np.zeros((len(idf), len(pieces)), np.float32)
    for i, piece in enumerate(pieces):
        at, weight = _vector(piece, idf)
        whole[at, i] = weight
    basis, latent = np.linalg.qr(whole)
    return basis, (latent / np.maximum(np.linalg.norm(latent, axis=0), 1e-9)).T


def _pieces(items: list) -> list[dict]:
    """Items in pieces of at most PIECE_WORDS words, each with the words of its answer."""
    out = []
    for row in items:
        words = w.text_words(pa.array([row.text]), w.not_alphanumeric(), True).hashes()
        answer = row.answer
        told = w.text_words(pa.array([answer]), w.not_alphanumeric(), True).hashes() if answer is not None else words[-ANSWER_WORDS:]
        many = max(1, -(-len(words) // PIECE_WORDS))
        out += [{"item": row.item_id, "words": piece, "answer": told} for piece in np.array_split(words, many) if len(piece)]
    return out


class Dense:
    """Finds all stretches of at most n / VERBATIM words that have the share VERBATIM of a piece's n words in order.

    Such a stretch lacks at most n - need words, so it has all but so many of any choice of the piece's words.  The rarest
    DENSE_SHARE of them is looked up; where enough of these stand close together, the words themselves are compared.
    """

    def __init__(self, pieces: list[np.ndarray], counts: np.ndarray):
        self.pieces = [p.tolist() for p in pieces]
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.need = np.ceil(sizes * VERBATIM - 1e-9).astype(np.int64)
        self.span = np.floor(sizes / VERBATIM + 1e-9).astype(np.int64)
        self.gap = int(self.span.max(initial=0)) + 1
        chosen = [np.argsort(counts[p], kind="stable")[: max(len(p) - n + 1, round(DENSE_SHARE * len(p)))] for p, n in zip(pieces, self.need.tolist())]
        self.least = np.array([len(c) for c in chosen], np.int64) - (sizes - self.need)
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[p[c] * max(1, len(pieces)) + j for j, (p, c) in enumerate(zip(pieces, chosen))]]))
        place, self.owner = np.divmod(pairs, max(1, len(pieces)))
        self.upto = np.searchsorted(place, np.arange(len(counts) + 1))
        own = [np.unique(p, return_counts=True) for p in pieces]
        most = max((len(p) for p, _ in own), default=0)  # the last number is that of all other words
        self.number, self.times = np.full((len(pieces), len(counts) + 1), most, np.int16), np.zeros((len(pieces), most + 1), np.int64)
        for j, (p, n) in enumerate(own):
            self.number[j, p], self.times[j, : len(p)] = np.arange(len(p)), n

    def _near(self, places: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, word) from which on enough of the piece's chosen words stand within its span."""
        at = np.flatnonzero(places >= 0)
        many = (self.upto[1:] - self.upto[:-1])[places[at]]
        at, many = at[many > 0], many[many > 0]
        word = np.repeat(at, many)
        piece = self.owner[np.repeat(self.upto[places[at]] - (np.cumsum(many) - many), many) + np.arange(len(word))]
        order = np.argsort(piece, kind="stable")  # words are in order
        piece, word = piece[order], word[order]
        last = np.arange(len(piece)) + self.least[piece] - 1
        inside = np.flatnonzero(last < len(piece))
        last = last[inside]
        good = (piece[last] == piece[inside]) & (texts[word[last]] == texts[word[inside]]) & (word[last] - word[inside] < self.span[piece[inside]])
        return piece[inside][good], word[inside][good]

    def _may_hold(self, pieces: np.ndarray, places: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether a stretch of words has enough of the piece's words, in whatever order."""
        out, most = np.zeros(len(pieces), bool), self.times.shape[1]
        for low in range(0, len(pieces), STRETCHES_AT_ONCE):
            some = slice(low, low + STRETCHES_AT_ONCE)
            piece, lengths = pieces[some], stop[some] - start[some]
            owner = np.repeat(np.arange(len(piece)), lengths)
            number = self.number[piece[owner], places[np.repeat(start[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(owner))]]
            found = np.bincount(owner * most + number, minlength=len(piece) * most).reshape(-1, most)
            out[some] = np.minimum(found, self.times[piece]).sum(axis=1) >= self.need[piece]
        return out

    def _holds(self, words: list, j: int) -> bool:
        """Whether a stretch of `words` holds the piece."""
        piece, need, span = self.pieces[j], int(self.need[j]), int(self.span[j])
        if longest_common(piece, words) < need:
            return False
        own = set(piece)
        return any(x in own and longest_common(piece, words[i : i + span]) >= need for i, x in enumerate(words[: len(words) - need + 1]))

    def passages(self, places: np.ndarray, first: np.ndarray) -> dict:
        """(text, passage of the text) -> pieces that a stretch starting in or before it holds; such a passage and the stride around it have the stretch whole."""
        counts, out = np.diff(first), {}
        if not self.pieces:
            return out
        texts = np.repeat(np.arange(len(counts)), counts)
        for low in range(0, len(places), WORDS_AT_ONCE):
            high = low + WORDS_AT_ONCE + self.gap  # what starts in a block may end in the next
            pieces, words = self._near(places[low:high], texts[low:high])
            words += low
            starts, stops = np.maximum(first[texts[words]], words - self.span[pieces] + 1), np.minimum(first[texts[words] + 1], words + self.span[pieces])
            good, done = self._may_hold(pieces, places, starts, stops), (-1, -1)
            for j, word, start, stop in zip(*(x[good].tolist() for x in (pieces, words, starts, stops))):
                if j == done[0] and word < done[1]:
                    continue
                text = int(texts[word])
                if self._holds(places[start:stop].tolist(), j):
                    many = max(1, -(-(int(counts[text]) - STRIDE) // STRIDE))
                    for begin in (start, word):
                        out.setdefault((text, min((begin - int(first[text])) // STRIDE, many - 1)), set()).add(j)
                    done = j, word + int(self.need[j])
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """Documents that hold benchmark items: (doc_id, item_id, cosine, lcs, kind), one row per document id and item.

    benchmark: (item_id, text), and an `answer` if there is one; otherwise the last words of an item stand for it.  `lcs` is the
    share of the item's content words (of all its words, if it has few) that a passage has in order.  `verbatim` from VERBATIM
    on; `paraphrase` from PARAPHRASE on, if the passage also has the share ANSWER of the answer's words.  Case, punctuation and
    line breaks do not count.  Null texts hold nothing, null and empty items are nowhere; rows with a null id are not searched.
    Repeated rows are found once.  A benchmark beyond PIECES pieces is searched block by block, each with its own space.
    """
    asked = benchmark.select("item_id", "text", (F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")).alias("answer"))
    asked = asked.where("item_id is not null and text is not null").distinct()
    words = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    blocks = max(1, -(-(asked.agg(F.sum(F.ceil(words / PIECE_WORDS))).first()[0] or 0) // PIECES))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    parts = []
    for block in range(blocks):
        items = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        parts.append(_pieces(sorted(items, key=lambda r: (r.item_id, r.text, r.answer or ""))))  # some PIECES pieces, or one long item
    vocabulary = Vocabulary(_hashes([piece for pieces in parts for piece in pieces]))
    coded = _coded(rows, vocabulary)
    counts, documents = _document_counts(coded, len(vocabulary.hashes))
    found = None
    for pieces in parts:
        part = _search(coded, vocabulary, counts, documents, pieces, least_cosine)
        found = part if found is None else found.union(part)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("lcs", "cosine", "kind")).alias("best"))
    return best.select(F.col("id").alias(doc_id), "item_id", "best.cosine", "best.lcs", "best.kind")


def _hashes(pieces: list[dict]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[p["words"] for p in pieces], *[p["answer"] for p in pieces]])


def _search(coded: DataFrame, known: Vocabulary, known_counts: np.ndarray, documents: int, pieces: list[dict], least: float) -> DataFrame:
    """What `coded`, whose places are those of the vocabulary `known`, holds of one block of pieces, which has words of its own."""
    vocabulary = Vocabulary(_hashes(pieces))
    order = np.argsort(-known_counts[known.places(vocabulary.hashes)], kind="stable")
    at = known.places(vocabulary.hashes)[order]
    local, counts = np.full(len(known.hashes) + 1, -1, np.int32), known_counts[at]
    local[at] = np.arange(len(at))
    placed, told = ([local[known.places(p[name])].astype(np.int64) for p in pieces] for name in ("words", "answer"))
    content = np.append(counts <= max(1, COMMON_SHARE * documents), True)
    idf = np.where(content[:-1], np.log((documents + 1) / (counts + 0.5)), COMMON_IDF).clip(COMMON_IDF).astype(np.float32)
    # A word that the benchmark lacks weighs as its typical content word does.
    unknown = float(np.median(idf[content[:-1]]) ** 2) if content[:-1].any() else 1.0
    basis, latent = _latent(placed, idf)
    space = _corpus_space(coded, local, idf, placed)
    meant = np.zeros((len(pieces), space.shape[1]), np.float32)
    for i, (piece, place, answer) in enumerate(zip(pieces, placed, told)):
        some, weight = _vector(place, idf)
        meant[i] = weight @ space[some]
        named = place[content[place]]
        piece["content"] = len(named) >= LEAST_CONTENT
        piece["places"] = (named if piece["content"] else place).tolist()
        piece["told"] = np.unique(answer)
    meant /= np.maximum(np.linalg.norm(meant, axis=1, keepdims=True), 1e-9)
    # What a passage's vector is multiplied with for its cosines with all pieces, but for its length: whole ones, then latent ones.
    both = np.hstack([basis @ latent.T, space @ meant.T])
    weights, own = np.append(idf.astype(float) ** 2, unknown), np.append(idf.astype(float) ** 2, 0.0)
    lift = np.append(idf * both.max(axis=1, initial=0).astype(float), 0.0)  # what a word adds to any product at most
    often = min(OFTEN, len(idf))
    dense = Dense(placed, counts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "places"):
            places, first = _decoded(batch)
            places, counts = local[places], np.diff(first)
            whole, inside, lifted = (np.concatenate([[0], np.cumsum(x[places])]) for x in (weights, own, lift))
            text, start, stop = _passages(counts, first)
            norm = whole[stop] - whole[start]
            hits = {}
            held, opens = dense.passages(places, first), np.searchsorted(text, np.arange(len(counts)))
            held = {int(opens[t]) + p: js for (t, p), js in held.items()}
            likely = (inside[stop] - inside[start] >= least**2 * norm) & (lifted[stop] - lifted[start] >= (least - 1e-4) * np.sqrt(norm))
            likely[list(held)] = True
            possible = np.flatnonzero(likely)
            for rows, frequent, columns, others in _matrix(places, start[possible], stop[possible], idf):
                some = possible[rows]
                cosines = (frequent @ both[:often] + others @ both[columns]) / np.sqrt(norm[some])[:, None]
                reached = (cosines[:, : len(pieces)] >= least) | (cosines[:, len(pieces) :] >= least)
                for row, i in enumerate(some.tolist()):
                    if i in held:
                        reached[row, list(held[i])] = True
                for row, j in np.argwhere(reached).tolist():
                    i, cosine = some[row], cosines[row, j]
                    key, piece = (text[i], pieces[j]["item"]), pieces[j]
                    low, high = max(first[text[i]], start[i] - STRIDE), min(first[text[i] + 1], stop[i] + STRIDE)
                    around = places[low:high]
                    shared = longest_common(piece["places"], (around[content[around]] if piece["content"] else around).tolist()) / len(piece["places"])
                    told = np.isin(piece["told"], around).mean() if len(piece["told"]) else 1.0
                    kind = "verbatim" if shared >= VERBATIM else "paraphrase" if shared >= PARAPHRASE and told >= ANSWER else None
                    if kind and (shared, cosine) > hits.get(key, (0.0, 0.0))[:2]:
                        hits[key] = (shared, float(cosine), kind)
            ids = batch["id"].to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(
                ([ids[t] for t, _ in hits], [i for _, i in hits], [v[1] for v in hits.values()], [v[0] for v in hits.values()], [v[2] for v in hits.values()]),
                (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()))], ["id", "item_id", "cosine", "lcs", "kind"])

    return coded.mapInArrow(search, "id long, item_id long, cosine double, lcs double, kind string")
