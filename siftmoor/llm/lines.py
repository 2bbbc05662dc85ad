"""Removal of lines that many documents repeat, by levelled sorted runs of line hashes.

Documents go through in batches, those with the largest ids first.  The distinct line hashes of a batch, each with its number
of documents and its largest id, become a run: a table bucketed and sorted by hash in the shared folder.  FANOUT runs of a level
are compacted into one of the next, summing the counts, so a hash lies in few runs at any time.

A hash that a run already counts in `least_docs` documents is settled: its lines go from any further batch, and its largest
document is known, as earlier batches have larger ids.  So each new batch is merge-anti-joined with the settled part of the
runs and adds only what they do not settle; a line in a third of all documents takes part in its first batches alone.  Runs and
batches have the same buckets, so a batch meets a run without a shuffle of the run.

A line is known by 128 bits of BLAKE2b of its key; two keys of 10 billion share them with probability 2^-62.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import shared_folder, stage

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FANOUT = 8, 4
_RUN = "hi long, lo long, n long, top long"
_BLANKS = " \t\n\x0b\x0c\r"


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines, and the index of each line's text; a null or empty text is one empty line."""
    lists = pc.split_pattern(w.compact(texts), "\n")
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def line_keys(lines: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the lines whose keys have `least_chars` code points, and the keys' hashes as rows of two integers."""
    at = np.flatnonzero(pc.greater_equal(pc.binary_length(lines), least_chars).to_numpy(zero_copy_only=False))
    keys = pc.ascii_lower(pc.ascii_trim(lines.take(pa.array(at)), characters=_BLANKS))
    long = pc.greater_equal(pc.utf8_length(keys), least_chars).to_numpy(zero_copy_only=False)
    coded = keys.filter(pa.array(long)).cast(pa.large_binary()).dictionary_encode()
    hashes = b"".join([blake2b(x.as_buffer(), digest_size=16).digest() for x in coded.dictionary])
    return at[long], np.frombuffer(hashes, "<i8").reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]


def _long_lines(least_chars: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text"):
            lines, text = _split(batch["text"])
            at, hashes = line_keys(lines, least_chars)
            rows = np.unique(np.column_stack([text[at], hashes]), axis=0) if len(at) else np.zeros((0, 3), np.int64)
            own = pa.array(rows[:, 0])
            yield pa.RecordBatch.from_arrays([batch["id"].take(own), batch["batch"].take(own), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["id", "batch", "hi", "lo"])

    return found


class LineRuns:
    """The runs of one corpus; batches must come with falling ids."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        keys.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            self._forget(full)

    def _merged(self, names: list[str]) -> DataFrame:
        """The hashes of several runs.  The files are read as such: Spark 4.1 takes a union of bucketed tables for grouped."""
        folder = shared_folder(self.spark)
        rows = self.spark.read.schema(_RUN).parquet(*[f"{folder}/{name}" for name in names])
        return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-join a batch (id, hi, lo) with the settled hashes of the runs and keep the rest as a run."""
        keys = lines.groupBy("hi", "lo").agg(F.count_distinct("id").alias("n"), F.max("id").alias("top"))
        for name in sum(self.levels, []):
            keys = keys.join(self.spark.table(name).where(F.col("n") >= self.least_docs).hint("merge"), ["hi", "lo"], "left_anti")
        self._write(keys, 0)

    def repeated(self) -> DataFrame:
        """Hashes (hi, lo) of lines in `least_docs` documents, with the largest id (top)."""
        names = sum(self.levels, [])
        found = stage(self._merged(names).where(F.col("n") >= self.least_docs).select("hi", "lo", "top"), "repeated-lines")
        self._forget(names)
        self.levels = []
        return found


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
                  batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Lines (id, hi, lo) that go: those in `least_docs` documents, except in the document with the largest id."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts = sorted(set(rows.approxQuantile("id", [i / batches for i in range(batches)], 0.01)))[1:]
    number = sum(((F.col("id") < cut).cast("int") for cut in cuts), F.lit(0))
    spark = docs.sparkSession
    lines = rows.withColumn("batch", number).mapInArrow(_long_lines(least_chars), "id long, batch int, hi long, lo long")
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, least_docs, fanout)
    for batch in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == batch).select("id", "hi", "lo"))
    return lines.join(runs.repeated(), ["hi", "lo"]).where("id < top").select("id", "hi", "lo")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
                           batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All rows and columns of docs with `text_col` less the lines that many documents repeat, joined by newlines.

    Adds `n_lines` (before) and `n_dropped`, in the place of columns of these names.  A null text is one empty line and becomes
    an empty text.  Rows that share an id are one document.  Rows with a null id count for no line and keep all of theirs.  All of
    a document's lines with one key go or stay together.
    """
    gone = dropped_lines(docs, id_col, text_col, least_docs, least_chars, batches, fanout)
    gone = gone.groupBy("id").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))
    kept = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    names = [f"k{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    both = rows.join(gone.hint("shuffle_hash"), "id", "left").select(*names, "text", "gone.hi", "gone.lo")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text"):
            lines, text = _split(batch["text"])
            keep = np.ones(len(lines), bool)
            touched = batch["hi"].is_valid().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(touched[text])
            if len(some):
                sets = [set(zip(hi.as_py(), lo.as_py())) if there else None for hi, lo, there in zip(batch["hi"], batch["lo"], touched.tolist())]
                at, hashes = line_keys(lines.take(pa.array(some)), least_chars)
                own = text[some[at]].tolist()
                keep[some[at]] = [(hi, lo) not in sets[i] for i, hi, lo in zip(own, *hashes.T.tolist())] if len(at) else True
            before = np.bincount(text, minlength=batch.num_rows)
            after = np.bincount(text[keep], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(after)]).astype(np.int32))
            left = pa.ListArray.from_arrays(offsets, lines.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pc.binary_join(left, pa.scalar("\n", lines.type)).cast(pa.string()), pa.array(before), pa.array(before - after)],
                                             [*names, "text", "n_lines", "n_dropped"])

    out = both.mapInArrow(drop, both.schema[: len(names)].add("text", "string").add("n_lines", "long").add("n_dropped", "long"))
    back = {c: F.col(n).alias(c) for c, n in zip(kept, names)} | {text_col: F.col("text").alias(text_col)}
    return out.select(*[back[c] for c in docs.columns if c in back], "n_lines", "n_dropped")
