"""Texts that already lie in tables, as scan input."""

from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.functions.text import unix_newlines


def spread(table: DataFrame, *key: str) -> DataFrame:
    """A table just read from storage in at least as many pieces as there are cores, cut by a unique key.

    Detectors are bound by computation, and a text table in few large pieces would
    leave cores idle.  Tables in more pieces than cores, as all large ones are, stay
    where they are: no text is moved.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(4 * cores, *key) if table.rdd.getNumPartitions() < cores else table


def file_text(table: DataFrame, repo_id: Column, path: Column, language: Column, text: Column) -> DataFrame:
    """``file_text`` from any table; ``(repo_id, path)`` must be unique."""
    columns = table.select(
        repo_id.cast("string").alias("repo_id"), path.cast("string").alias("path"),
        language.cast("string").alias("language"), unix_newlines(text).alias("text"))
    return columns.select("repo_id", "path", "language", F.length("text").alias("file_size"), "text",
                          F.lit(None).cast("string").alias("scan_error"))
