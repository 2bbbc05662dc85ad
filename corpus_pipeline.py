"""The corpus pipeline: documents in, a clean and mixed corpus out.

Each stage works on all that the one before it kept and returns the columns of documents, the last one those of the mix as
well.  A stage is written as Parquet and read again.  Rows with a null id pass; doc_id is the key of documents, so rows that
repeat an id share its fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmoor.llm import decontamination, mixing, shingles, substrings, toxicity
from siftmoor.llm.common import stage
from siftmoor.llm.queries import ORACLE, QUERIES, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, rejects go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    found = shingles.near_duplicates(docs.select("doc_id", "text"))
    return docs.join(found.where("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in a document with a smaller id as well are cut out of the texts."""
    return substrings.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mix of sources."""
    return mixing.mixed(docs)


STAGES = [("toxicity", toxic_out), ("ngram_jaccard", near_copies_out), ("substrings", repeats_out), ("decontamination", benchmark_out), ("mixing", mix)]

# Learned and sequential stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


QUERIES["pipeline"] = run
