"""Shared by the operators: staged tables, folds, sizes and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BUCKET_BYTES = 24 << 20
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LARGE_ROWS = 4
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folders.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="staged-")
        _own_folders[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs inside go as soon as it is done; Spark keeps them until their plan is collected."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def stage(table: DataFrame, name: str, drop_shuffles: bool = False, large_rows: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    With `large_rows` a group of rows has LARGE_ROWS only: Parquet writes and reads a group at a time, by default of 128 MB, and
    looks at the size after 100 rows.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = table.write.option("compression", "zstd")
    if large_rows:
        writer = writer.option("parquet.block.row.count.limit", LARGE_ROWS).option("parquet.page.size.row.check.min", 1)
    with shuffles_dropped(spark) if drop_shuffles else contextlib.nullcontext():
        writer.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the decimal text of an id, modulo `parts`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts, F.lit(-1))


def few_of_each(rows: DataFrame, label: str, wanted: int) -> DataFrame:
    """Of distinct rows (id, label) the `wanted` ids of each label whose hashes are the smallest.  There must be few labels.

    Only ids with a hash below a bound are ranked, which is set by the label's count so that `wanted` and eight standard deviations
    more are expected below it.  So no task ranks all ids of a label, at any size.
    """
    enough = wanted + 8 * wanted**0.5 + 64
    counts = rows.groupBy(label).agg(F.count("*").alias("total"))
    bound = F.least(F.lit(1.0), F.lit(enough) / F.col("total")) * 2.0**64 - 2.0**63
    near = rows.join(F.broadcast(counts), label).where(F.xxhash64("id").cast("double") <= bound)
    order = Window.partitionBy(label).orderBy(F.xxhash64("id"), "id")
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= wanted).select("id", label)


def text_size(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def buckets_for(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets keep each near `bucket_bytes`."""
    return max(16, -(-size // bucket_bytes))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected `edges` (a, b): each node that has an edge with its smallest reachable node.

    Alternates large-star and small-star steps: every step hands each node's neighbours to its smallest neighbour, so trees
    flatten in a logarithmic number of rounds.  Only grouped minima and joins are used; no neighbour list is gathered.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        seen = state
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        links = stage(small.where("u <> v").distinct(), "links")


def sum_vectors(rows: DataFrame, kind: str, salts: int = 64) -> dict:
    """The sum of the numpy vectors (piece, vector) of each piece, added in two steps so that no task gets those of all tasks."""
    import numpy as np
    import pyarrow as pa

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), kind).astype(kind) for x in table["vector"])
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "vector": pa.array([total.tobytes()], pa.binary())})

    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    once = salted.groupBy("piece", "salt").applyInArrow(add, "piece int, vector binary")
    return {r.piece: np.frombuffer(r.vector, kind) for r in once.groupBy("piece").applyInArrow(add, "piece int, vector binary").collect()}
