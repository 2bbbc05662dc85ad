"""Language identification: the family first, then one-versus-one linear support vector machines within the family.

Texts become normalised counts of hashed byte trigrams of the whole text.  The machines are fitted on a bounded sample of
labelled rows (`sample_rows` in all, the same number of each language, chosen by a hash of the id); everything else runs over
all rows in one narrow stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import few_of_each

SAMPLE_ROWS = 2048
MOST_LANGUAGES = 256
BUCKETS = 2048
ROWS = 1024
# The families of common languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "uz"],
    "uralic": ["et", "fi", "hu"],
}


def trigrams(column: pa.Array) -> np.ndarray:
    """One row of BUCKETS numbers of length 1 per text; zeros for texts under three bytes."""
    data, offsets = w.text_bytes(column)
    sizes, count = np.diff(offsets), len(column)
    if len(data) < 3:
        return np.zeros((count, BUCKETS), np.float32)
    wide = w.lowered(data).astype(np.uint32)
    code = ((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - 11)
    text = np.repeat(np.arange(count), sizes)[:-2]
    whole = np.ones(len(code), bool)
    for back in (1, 2):  # grams that would run into the next text
        at = offsets[1:] - back
        whole[at[(at >= 0) & (at < len(code)) & (sizes >= back)]] = False
    found = np.bincount(text[whole] * BUCKETS + code[whole], minlength=count * BUCKETS).reshape(count, BUCKETS)
    rows = np.log1p(found).astype(np.float32)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def linear_svm(rows: np.ndarray, signs: np.ndarray, penalty: float = 30.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of a support vector machine with squared hinge loss, by accelerated gradient descent."""
    x = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    each = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())).astype(np.float32) * np.float32(penalty)
    signs, vector = signs.astype(np.float32), np.ones(x.shape[1], np.float32)
    for _ in range(20):
        vector = x.T @ (each * (x @ vector))
        vector /= np.linalg.norm(vector) or 1
    step = np.float32(1 / (1 + 2 * np.linalg.norm(x.T @ (each * (x @ vector)))))
    now = before = np.zeros(x.shape[1], np.float32)
    for i in range(steps):
        ahead = now + np.float32(i / (i + 3)) * (now - before)
        short = np.maximum(0, 1 - signs * (x @ ahead))
        before, now = now, ahead - step * (ahead - 2 * (x.T @ (each * signs * short)))
    return now


class Hierarchy:
    """Families, their languages, and one machine for each pair of families and each pair of languages of a family."""

    def __init__(self, rows: np.ndarray, labels: list[str]):
        family = {language: name for name, members in FAMILIES.items() for language in members}
        self.languages, labels = sorted(set(labels)), np.array(labels)
        self.family = np.array([family.get(x, x) for x in self.languages])
        self.families = sorted(set(self.family))
        of = np.array([family.get(x, x) for x in labels])
        self.family_pairs = list(combinations(range(len(self.families)), 2))
        self.pairs = [(a, b) for a, b in combinations(range(len(self.languages)), 2) if self.family[a] == self.family[b]]
        machines = [self._machine(rows, of, self.families[a], self.families[b]) for a, b in self.family_pairs]
        machines += [self._machine(rows, labels, self.languages[a], self.languages[b]) for a, b in self.pairs]
        self.weights = np.array(machines, np.float32).reshape(-1, BUCKETS + 1)

    @staticmethod
    def _machine(rows, labels, one, other):
        used = (labels == one) | (labels == other)
        return linear_svm(rows[used], np.where(labels[used] == one, 1.0, -1.0))

    @staticmethod
    def _votes(margins: np.ndarray, pairs: list, count: int) -> np.ndarray:
        """The least margin of each class over its pairs."""
        least = np.full((len(margins), count), np.inf)
        for i, (a, b) in enumerate(pairs):
            least[:, a], least[:, b] = np.minimum(least[:, a], margins[:, i]), np.minimum(least[:, b], -margins[:, i])
        return least

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the language of each row, and a score from 0 to 1."""
        margins = rows @ self.weights[:, :-1].T + self.weights[:, -1]
        split, every = len(self.family_pairs), np.arange(len(rows))
        families = self._votes(margins[:, :split], self.family_pairs, len(self.families))
        chosen = families.argmax(axis=1)
        languages = self._votes(margins[:, split:], self.pairs, len(self.languages))
        within = np.searchsorted(self.families, self.family)
        languages[within[None, :] != chosen[:, None]] = -np.inf
        best = languages.argmax(axis=1)
        sure = np.minimum(families[every, chosen], languages[every, best])
        return best, 1 / (1 + np.exp(-4 * np.clip(sure, -8, 8)))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Hierarchy | None:
    """The hierarchy learned from rows with an id, a text and a language; None without any.

    Of several texts of an id and a language the smallest counts.
    """
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("id is not null and lang is not null and text is not null")
    languages = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    chosen = few_of_each(labelled.select("id", "lang").distinct(), "lang", max(1, sample_rows // max(1, languages)))
    sample = labelled.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text", rows=ROWS):
            yield pa.RecordBatch.from_arrays([batch["lang"], w.binary(trigrams(batch["text"]).astype(np.float16))], ["lang", "features"])

    rows = sample.mapInArrow(features, "lang string, features binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.features))
    return Hierarchy(np.array([np.frombuffer(r.features, np.float16) for r in rows]).astype(np.float32), [r.lang for r in rows])


def identify(docs: DataFrame, model: Hierarchy | None, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns `keep`, the language (`lang_pred`) and its score for every row; only the whole text is looked at.

    `und` with score 0 for a null text, one without any letter, or without a model.  Every row gives one row, repeated ones too.
    """
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], has_letter, F.col(text).alias("_text"))
    kept, names_kept = rows.schema[: len(keep)], list(keep)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "_text", rows=ROWS):
            known = batch["_letter"].to_numpy(zero_copy_only=False) & (model is not None)
            if known.any():
                best, score = model.predict(trigrams(batch["_text"]))
                names = [model.languages[i] if k else "und" for i, k in zip(best, known)]
            else:
                names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names_kept)], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))],
                                             [*names_kept, "lang_pred", "score"])

    return rows.mapInArrow(label, kept.add("lang_pred", "string").add("score", "double"))
