"""Nearest neighbours by a block matrix join of quantised vectors.

Vectors are packed into blocks.  Every query block meets every candidate block once; the product of their int8 codes gives
each cosine up to a known error.  Pairs whose upper bound reaches the k-th lower bound are computed again from the original
vectors in double precision and kept in a heap per query.  The result is exact: no pair is dropped unless bounded away.

Blocks are shuffled to where they meet, never broadcast: Spark takes a packed and copied block for as small as the rows it was
made of, so it would send all copies of all queries through the driver.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

BLOCK = 1024
OPEN_HEAPS = 1 << 16
COPIES = 2.5
HELD = 1 << 21
_SLACK = 1e-5
_PACKED = "dim int, ids binary, vectors binary"


def _usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _pack(batches: Iterator[pa.RecordBatch], kind: type = np.float64) -> Iterator[pa.RecordBatch]:
    """Rows (id, dim, vector) as blocks of BLOCK rows of one dimension, with the components as `kind`."""
    waiting: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, vectors = zip(*waiting.pop(dim))
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([np.concatenate(vectors).tobytes()], pa.binary())})

    for batch in batches:
        values, offsets = batch["vector"].values.to_numpy(zero_copy_only=False), batch["vector"].offsets.to_numpy()
        for i, (key, dim) in enumerate(zip(batch["id"].to_pylist(), batch["dim"].to_pylist())):
            waiting.setdefault(dim, []).append((key, values[offsets[i] : offsets[i + 1]].astype(kind)))
            if len(waiting[dim]) == BLOCK:
                yield block(dim)
    for dim in list(waiting):
        yield block(dim)


class _Block:
    """A block with its int8 codes; `error` bounds how far a unit vector is from its scaled code."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes, kind: type = np.float64):
        self.ids, self.vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)
        # Dividing by the largest component first keeps the squares of very large and very small vectors in range.
        scaled = self.vectors / np.abs(self.vectors).max(axis=1, keepdims=True)
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rest = unit - self.codes * self.scale[:, None]
        self.error = np.sqrt((rest * rest).sum(axis=1))
        self.factors, self.steps = self.codes.astype(np.float32), self.scale.astype(np.float32)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, in double precision; of rows out of the range of squares, after scaling."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        found = (left * right).sum(axis=1) / (np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1)))
    odd = ~np.isfinite(found)
    if odd.any():
        a, b = (x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True) for x in (left, right))
        found[odd] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return found


def _survivors(query: _Block, other: _Block, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the tile that may be among the k best of their query; `least` is each query's k-th best score so far.

    One bound a query, that of the worst candidate, picks the pairs for which the bounds of their own are computed.
    """
    near = query.factors @ other.factors.T
    near *= query.steps[:, None]
    near *= other.steps
    widest = query.error + (1 + query.error) * other.error.max() + _SLACK
    if len(other.ids) > k and np.isinf(least).any():
        near[query.ids[:, None] == other.ids[None, :]] = -np.inf
        least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - widest)
    left, right = np.nonzero(near >= (least - widest - _SLACK).astype(np.float32)[:, None])
    bound = query.error[left] + (1 + query.error[left]) * other.error[right] + _SLACK
    kept = (near[left, right] + bound >= least[left]) & (query.ids[left] != other.ids[right])
    return left[kept], right[kept]


def grid(cells: int, queries: int, candidates: int) -> tuple[int, int]:
    """Lines of query blocks and columns of candidate blocks, about `cells` in all, that copy the fewest vectors.

    A query goes to every column and a candidate to every line, so columns * queries + lines * candidates are moved.
    """
    columns = min(cells, max(1, round((cells * candidates / max(1, queries)) ** 0.5)))
    return max(1, cells // columns), columns


def cells_for(most: int, cores: int, queries: int, candidates: int) -> int:
    """How many cells the grid may have: enough for the cores, and as many as copy at most about COPIES times the candidates."""
    return max(1, min(most, max(2 * cores, int(COPIES**2 / 4 * candidates / max(1, queries)))))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest cosine for each query row: (query_id, rank, vec_id, score), rank from 1, ties to the smaller id.

    Queries are the rows for which `is_query` holds; candidates are all rows but those with the query's own id, of the same
    number of components.  Vectors that are null, empty or zero or have a null or non-finite component take no part, nor do
    rows without id.  Repeated candidates count one by one; a repeated query id is searched once, with its smallest vector.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), F.col(vector_col).alias("vector"), is_query.alias("asked"))
    asked = rows.where("asked").groupBy("id").agg(F.min("vector").alias("vector")).select("id", F.size("vector").alias("dim"), "vector")
    total, count = (n or 0 for n in rows.agg(F.count("*"), F.count_if("asked")).first())
    lines, columns = grid(cells_for(cells, spark.sparkContext.defaultParallelism, count, total), count, total)
    kind = np.float32 if vectors.schema[vector_col].dataType.elementType == FloatType() else np.float64  # each holds its components exactly
    pack = functools.partial(_pack, kind=kind)
    queries = asked.repartition(-(-max(1, count) // BLOCK), F.xxhash64("id")).mapInArrow(pack, _PACKED)
    others = rows.drop("asked").mapInArrow(pack, _PACKED)
    dealt = lambda ids, number: F.pmod(F.xxhash64(ids), F.lit(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    asking = queries.select(dealt("ids", lines).alias("line"), every(columns).alias("column"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    tiles = others.select("*", dealt("ids", columns).alias("column"), every(lines).alias("line")).join(asking.hint("merge"), ["line", "column", "dim"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        blocks: dict[tuple, _Block] = {}

        def block(*packed) -> _Block:
            if packed not in blocks:
                if sum(b.codes.size for b in blocks.values()) > HELD:
                    blocks.clear()
                blocks[packed] = _Block(*packed, kind)
            return blocks[packed]

        def out() -> pa.RecordBatch:
            flat = [(q, -negative, score) for q, heap in heaps.items() for score, negative in heap]
            heaps.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                tile = {name: batch[name][i].as_py() for name in ("dim", "ids", "vectors", "q_ids", "q_vectors")}
                query, other = block(tile["dim"], tile["q_ids"], tile["q_vectors"]), block(tile["dim"], tile["ids"], tile["vectors"])
                least = np.array([heaps[q][0][0] if len(heaps.get(q, ())) == k else -np.inf for q in query.ids.tolist()])
                left, right = _survivors(query, other, k, least)
                for at in range(0, len(left), 1 << 16):
                    a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
                    scores = cosines(query.vectors[a], other.vectors[b])
                    for q, v, score in zip(query.ids[a].tolist(), other.ids[b].tolist(), scores.tolist()):
                        heap = heaps.setdefault(q, [])
                        if len(heap) < k:
                            heapq.heappush(heap, (score, -v))
                        elif (score, -v) > heap[0]:
                            heapq.heapreplace(heap, (score, -v))
                if len(heaps) > OPEN_HEAPS:
                    yield out()
        yield out()

    best = tiles.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
