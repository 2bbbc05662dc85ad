"""Toxicity scores by a counterfactual-regularised logistic classifier.

Features are the distinct words of a text and their first bytes, hashed; the classifier keeps those that part the labels most
clearly.  For each labelled text that mentions a group, a counterfactual with the mention swapped for another group is made,
and the fit penalises the squared change of the score, so that a neutral mention does not move it.  The bias goes half of the way
from balanced labels to their shares among all.

All labelled texts are learned from (`sample_rows` asks for fewer).  Tasks count their features in hash buckets; then each text
is staged as the places of its kept features, and the driver minimises the loss by steps of L-BFGS, whose losses and slopes are
sums over the staged rows.  The sums are whole numbers, so that neither the order nor the cut of the rows changes the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import buckets_for, few_of_each, stage, sum_vectors, text_size

MOST_FEATURES = 1024
LEAST_Z, LEAST_TEXTS = 3.0, 3
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
FAIRNESS, RIDGE = 10.0, 3e-4
BUCKET_BYTES = 12 << 20
MERGED_FEATURES = 1 << 20
ROWS_AT_ONCE = 4096
STEPS, MEMORY, LEAST_GAIN = 60, 10, 1e-6
_PIECES = 16
_SLOPE, _LOSS = 2.0**32, 2.0**28  # the fixed points of slopes and losses
# Terms for groups of people, interchangeable within a line.
IDENTITY_TERMS = [
    "women men girls boys woman man girl boy lesbian gay bisexual transgender straight",
    "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists catholic catholics",
    "black white asian african european american latino arab indian chinese mexican french german spanish english",
    "immigrant immigrants refugee refugees foreigner foreigners migrant migrants native natives",
    "disabled blind deaf elderly young old",
    "femmes hommes femme homme musulman musulmans juif juifs immigrés réfugiés étrangers",
    "frauen männer frau mann muslime christen juden flüchtlinge ausländer einwanderer",
    "mujeres hombres mujer hombre musulmanes cristianos judíos inmigrantes refugiados extranjeros",
]


def word_features(words: w.Words) -> np.ndarray:
    """Hashes of each word, whole and by its first bytes; one row per kind of feature."""
    kinds = [words.hashes()] + [words.hashes(length) ^ np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for length in PREFIXES]
    return np.array(kinds).reshape(1 + len(PREFIXES), -1)


def _terms() -> dict[int, tuple[set[int], set[int]]]:
    """For the hash of each identity term: its features and those of the term it is swapped for."""
    out = {}
    for line in IDENTITY_TERMS:
        features = word_features(w.text_words(pa.array([line]), w.not_letters(), True)).T.tolist()
        for one, other in zip(features, features[1:] + features[:1]):
            out[one[0]] = (set(one), set(other))
    return out


class Classifier:
    """Sorted feature hashes with their weights, and a bias; without labels of both kinds only the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[features & np.uint64(0xFFFF)] = True

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of each text."""
        words = w.text_words(column, w.not_letters(), True)
        total = np.full(len(column), self.bias)
        if len(self.features) and len(words.starts):
            hashes = word_features(words)
            kind, at = np.nonzero(self.maybe[hashes & np.uint64(0xFFFF)])
            found = hashes[kind, at]
            place = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            hit = self.features[place] == found
            pairs = np.unique(words.texts()[at[hit]] * len(self.features) + place[hit])
            total += np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], len(column))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _feature_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """In how many texts of each label every feature is (bucket, features, toxic, clean): packed rows, a feature may be in several."""

    def sums(parts: list) -> tuple[np.ndarray, ...]:
        features, *counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(features)
        features = features[order]
        opens = np.flatnonzero(np.append(True, features[1:] != features[:-1])) if len(features) else np.zeros(0, np.int64)
        return features[opens], *(np.add.reduceat(c[order], opens) if len(opens) else c for c in counts)

    def emit(parts: list) -> pa.RecordBatch:
        columns = sums(parts)
        order, upto = w.by_bucket(columns[0] % np.uint64(buckets), buckets)
        columns, full = [x[order] for x in columns], np.flatnonzero(np.diff(upto)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(w.binary([x[upto[b] : upto[b + 1]] for b in full]) for x in columns)], ["bucket", "features", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in w.slices(batches, "text"):
            toxic = batch["toxic"].to_numpy() == 1
            words = w.text_words(batch["text"], w.not_letters(), True)
            hashes = word_features(words)
            _, first, place = np.unique(hashes[0], return_index=True, return_inverse=True)
            text, word = np.divmod(np.unique(words.texts() * max(1, len(first)) + place), max(1, len(first)))
            for kind in hashes[:, first]:
                features, own = np.unique(kind, return_inverse=True)
                owner, at = np.divmod(np.unique(text * max(1, len(features)) + own[word]), max(1, len(features)))
                both = [np.bincount(at[mark[owner]], minlength=len(features)).astype(np.int64) for mark in (toxic, ~toxic)]
                parts, held = [*parts, (features, *both)], held + len(features)
            if held > MERGED_FEATURES:
                parts = [sums(parts)]
                held = len(parts[0][0])
            if held > MERGED_FEATURES // 2:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    return rows.mapInArrow(count, "bucket int, features binary, toxic binary, clean binary")


def _telling(rows: DataFrame, positive: int, negative: int) -> np.ndarray:
    """Sorted hashes of the features that part the labels most clearly, and of the identity terms."""

    total = positive + negative

    def surprise(seen: np.ndarray, texts: np.ndarray, marked: int) -> np.ndarray:
        """A cell's part of the likelihood ratio of feature and label, which many texts with a slight lean do not outdo, as they do in a
        ratio of odds over its deviation, that of a feature of one label alone."""
        return seen * np.log(np.maximum(seen, 1e-300) * total / np.maximum(texts * marked, 1e-300))

    def rate(key: tuple, table: pa.Table) -> pa.Table:
        features = w.joined(table["features"], np.uint64)
        features, place = np.unique(features, return_inverse=True)
        a, b = (np.bincount(place, w.joined(table[n], np.int64), len(features)) for n in ("toxic", "clean"))
        # Only features that are LEAST_TEXTS times in texts of one label can part the labels clearly.
        often = np.maximum(a, b) >= LEAST_TEXTS
        z = np.sqrt(2 * np.maximum(0, sum(surprise(*x) for x in ((a, a + b, positive), (b, a + b, negative), (positive - a, total - a - b, positive), (negative - b, total - a - b, negative)))))
        good = often & (z >= LEAST_Z)
        return pa.table({"feature": pa.array(features[good].view(np.int64)), "z": pa.array(z[good])})

    counts = _feature_counts(rows, buckets_for(text_size(rows), BUCKET_BYTES))
    found = counts.groupBy("bucket").applyInArrow(rate, "feature long, z double").orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()
    named = np.fromiter({f for pair in _terms().values() for f in pair[0]}, np.uint64)
    return np.unique(np.concatenate([np.array([r.feature for r in found], np.int64).view(np.uint64), named]))


def _placed(rows: DataFrame, features: np.ndarray) -> DataFrame:
    """Of each text the places of its kept features, and of its counterfactual if it mentions a group: (toxic, own, swapped)."""
    maybe = Classifier(features, np.zeros(0), 0.0).maybe

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {t: [np.searchsorted(features, np.array(sorted(x), np.uint64)) for x in pair] for t, pair in _terms().items()}
        known = np.array(sorted(terms), np.uint64)
        for batch in w.slices(batches, "text"):
            words = w.text_words(batch["text"], w.not_letters(), True)
            hashes, texts = word_features(words), words.texts()
            kind, at = np.nonzero(maybe[hashes & np.uint64(0xFFFF)])
            found = hashes[kind, at]
            where = np.minimum(np.searchsorted(features, found), len(features) - 1)
            hit = features[where] == found
            text, own = np.divmod(np.unique(texts[at[hit]] * len(features) + where[hit]), len(features))
            upto = np.searchsorted(text, np.arange(batch.num_rows + 1))
            sets, other = [own[a:b].astype(np.uint16) for a, b in zip(upto[:-1], upto[1:])], [None] * batch.num_rows
            mentions = np.flatnonzero(np.isin(hashes[0], known))
            named: dict[int, set[int]] = {}
            for t, term in zip(texts[mentions].tolist(), hashes[0][mentions].tolist()):
                named.setdefault(t, set()).add(term)
            for t, held in named.items():
                gone, come = (np.concatenate([terms[term][i] for term in held]) for i in (0, 1))
                other[t] = np.union1d(np.setdiff1d(sets[t], gone), come).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([batch["toxic"], w.binary(sets), pa.array(other, pa.binary())], ["toxic", "own", "swapped"])

    return stage(rows.mapInArrow(place, "toxic int, own binary, swapped binary"), "places")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place of each kept feature."""
    sets = [np.frombuffer(x.as_buffer(), np.uint16) for x in column]
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([np.zeros(0, np.uint16), *sets]).astype(np.int64)


def _dense(column: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(column), size), np.float32)
    out[_flat(column)] = 1
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _curvature(placed: DataFrame, named: np.ndarray, size: int, heavy: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """The products of all rows with themselves (a clean row counts heavy[0] times, a toxic one heavy[1] times; the last column is
    one), those of the changes by swaps, in the named columns, and the number of swaps."""
    corner = np.triu_indices(size + 1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, swaps = np.zeros((size + 1, size + 1)), np.zeros(len(named) ** 2 + 1)
        for batch in _pieces(batches):
            x = _dense(batch["own"], size + 1)
            x[:, -1] = 1
            total += x.T @ (x * np.where(batch["toxic"].to_numpy() == 1, heavy[1], heavy[0]).astype(np.float32)[:, None])
            pairs = batch.filter(batch["swapped"].is_valid())
            change = (_dense(pairs["own"], size) - _dense(pairs["swapped"], size))[:, named]
            swaps += np.append((change.T @ change).ravel(), len(change))
        whole = np.array_split(total[corner].astype(np.int64), _PIECES) + [swaps.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int32()), w.binary(whole)], ["piece", "vector"])

    parts = sum_vectors(placed.mapInArrow(multiply, "piece int, vector binary"), "int64")
    total = np.zeros((size + 1, size + 1))
    total[corner] = np.concatenate([parts[i] for i in range(_PIECES)])
    return total + np.triu(total, 1).T, parts[_PIECES][:-1].reshape(len(named), -1).astype(float), int(parts[_PIECES][-1])


def _slope(placed: DataFrame, vector: np.ndarray) -> np.ndarray:
    """For clean and toxic rows a line each: the sum of their log losses and its slope."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(vector) + 1), np.int64)
        for batch in _pieces(batches):
            row, place = _flat(batch["own"])
            toxic = batch["toxic"].to_numpy()
            value = np.clip(np.bincount(row, vector[place], batch.num_rows) + vector[-1], -50, 50)
            wrong = np.rint((1 / (1 + np.exp(-value)) - toxic) * _SLOPE)
            loss = np.rint(np.logaddexp(0, np.where(toxic == 1, -value, value)) * _LOSS)
            for mark in (0, 1):
                own = toxic[row] == mark
                total[mark, 1:] += np.bincount(place[own], wrong[row[own]], len(vector)).astype(np.int64)
                total[mark, 0] += int(loss[toxic == mark].sum())
                total[mark, -1] += int(wrong[toxic == mark].sum())
        yield pa.RecordBatch.from_arrays([w.binary([total])], ["total"])

    total = sum(np.frombuffer(r.total, np.int64).reshape(2, -1) for r in placed.mapInArrow(add, "total binary").collect())
    return total / np.append(_LOSS, np.full(len(vector), _SLOPE))


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Of a positive definite matrix, by halves: LAPACK sees small blocks only (with its threads it hung on 1,300 columns beside Spark)."""
    half = len(matrix) // 2
    if half < 64:
        return np.linalg.inv(matrix)
    left, across = _inverse(matrix[:half, :half]), matrix[:half, half:]
    both = left @ across
    right = _inverse(matrix[half:, half:] - across.T @ both)
    return np.block([[left + both @ right @ both.T, -both @ right], [-right @ both.T, right]])


def _minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], curvature: np.ndarray) -> np.ndarray:
    """Where a smooth convex loss is least, by L-BFGS from zero, whose first curvature is given."""
    inverse, now, pairs = _inverse(curvature), np.zeros(len(curvature)), []
    value, slope = loss(now)
    for _ in range(STEPS):
        turn, scales = slope.copy(), []
        for s, y in reversed(pairs):
            scales.append(s @ turn / (s @ y))
            turn -= scales[-1] * y
        turn = inverse @ turn
        for (s, y), scale in zip(pairs, reversed(scales)):
            turn += (scale - y @ turn / (s @ y)) * s
        gain, length = slope @ turn, 1.0
        if gain < LEAST_GAIN:
            break
        ahead, ahead_slope = loss(now - turn)
        while ahead > value - 1e-4 * length * gain and length > 1e-6:
            length /= 2
            ahead, ahead_slope = loss(now - length * turn)
        if ahead >= value:
            break
        step, bend = -length * turn, ahead_slope - slope
        if step @ bend > 0:
            pairs = [*pairs, (step, bend)][-MEMORY:]
        now, value, slope = now + step, ahead, ahead_slope
    return now


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample_rows: int | None = None) -> Classifier:
    """The classifier learned from `labels` (doc_id, toxic 0 or 1) and the texts of `docs`, from `sample_rows` of each label if asked.

    Rows with a null id, label or text are left out; an id with several labels has the largest, one with several texts the smallest.
    Without labels of both kinds only the bias is learned.
    """
    ids = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    there = ids.join(texts.select("id"), "id", "left_semi")
    counts = {r.toxic: r["count"] for r in there.groupBy("toxic").count().collect()}
    negative, positive = (counts.get(mark, 0) if sample_rows is None else min(sample_rows, counts.get(mark, 0)) for mark in (0, 1))
    if not positive or not negative:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log((positive + 0.5) / (negative + 0.5))))
    chosen = ids if sample_rows is None else F.broadcast(few_of_each(there, "toxic", sample_rows))
    rows = stage(texts.join(chosen, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "labelled")
    features = _telling(rows, positive, negative)
    placed, size, each = _placed(rows, features), len(features), (0.5 / negative, 0.5 / positive)
    named = np.searchsorted(features, np.unique(np.fromiter({f for pair in _terms().values() for f in pair[0]}, np.uint64)))
    heavy = tuple(max(1, round(256 * x / max(each))) for x in each)
    products, swaps, pairs = _curvature(placed, named, size, heavy)
    decay, penalty = np.append(np.full(size, RIDGE), 0.0), np.zeros((size + 1, size + 1))
    penalty[np.ix_(named, named)] = FAIRNESS / max(1, pairs) * swaps
    penalty += np.diag(decay)

    def loss(vector: np.ndarray) -> tuple[float, np.ndarray]:
        told = np.array(each) @ _slope(placed, vector)
        return told[0] + 0.5 * vector @ penalty @ vector, told[1:] + penalty @ vector

    vector = _minimised(loss, 0.25 * max(each) / 256 * products + penalty)
    share = counts[1] / sum(counts.values())
    return Classifier(features, vector[:-1], float(vector[-1]) + 0.5 * float(np.log(share / (1 - share))))


def score(docs: DataFrame, model: Classifier, keep: dict[str, Column], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep`, `score` and `predicted` (1 from `threshold` on) of every row; only the whole text is looked at.

    A null text counts as empty and gets the score of a text without any feature.  Every row gives one row, repeated ones too.
    """
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))

    kept, names_kept = rows.schema[: len(keep)], list(keep)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "_text"):
            scores = model.scores(batch["_text"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names_kept)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             [*names_kept, "score", "predicted"])

    return rows.mapInArrow(judge, kept.add("score", "double").add("predicted", "integer"))


def without_toxic(docs: DataFrame, model: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose text scores under `threshold`."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, text):
            yield batch.filter(pa.array(model.scores(batch[text]) < threshold))

    return docs.mapInArrow(clean, docs.schema)
