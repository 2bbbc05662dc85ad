"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of `block` documents.  With the share w of all weights, an exact fraction, the k-th block of a
source (from 0) is released at slot floor(k / w) and due by slot ceil((k + 1) / w); in each slot the released block with the
earliest deadline runs.  Every prefix of the order then holds each source's share to within less than one block, however long
it is.  When a source ends, the others go on with their weights scaled up: a new phase.

The driver runs through the slots and keeps only how many blocks of each source have run at every PERIOD-th slot; from there
tasks make the slots between, and the slots go to the documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BLOCK = 8
PERIOD = 1 << 14
MOST_SOURCES = 256
SLOTS_PER_ROW = 512
SALTS_PER_PARTITION = 4


def shares(weights: dict, period: int = PERIOD) -> dict:
    """Whole numbers of slots near the weights, at least one each, by largest remainders, for a plan that repeats."""
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    while (rest := period - sum(out.values())) > 0:
        for s in order[:rest]:
            out[s] += 1
    while (rest := sum(out.values()) - period) > 0:
        for s in [s for s in reversed(order) if out[s] > 1][:rest]:
            out[s] -= 1
    return out


def exact(weights: dict) -> dict:
    """Whole numbers in just the ratio of the weights."""
    fractions = {s: Fraction(w) for s, w in weights.items()}
    whole = math.lcm(*(f.denominator for f in fractions.values()))
    return {s: int(f * whole) for s, f in fractions.items()}


def schedule(weights: list[int], ran: list[int], slot: int) -> Iterator[int]:
    """The source of each slot from `slot` on, earliest deadline first; ties by the order of the sources.

    ran: blocks of each source that have run before, all there is to know of the slots before; it is kept up to date.
    """
    total = sum(weights)
    ready, waiting = [], [(n * total // w, i) for i, (n, w) in enumerate(zip(ran, weights))]
    heapq.heapify(waiting)
    while True:
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(ran[i] + 1) * total // weights[i]), i))
        deadline, i = heapq.heappop(ready)
        assert slot < deadline, "a block would miss its deadline"
        ran[i] += 1
        heapq.heappush(waiting, (ran[i] * total // weights[i], i))
        yield i
        slot += 1


def one_period(slots: dict) -> dict:
    """The slots of each source in one period, if they have so many each."""
    order, out = sorted(slots, key=str), {s: [] for s in slots}
    for slot, i in zip(range(sum(slots.values())), schedule([slots[s] for s in order], [0] * len(order), 0)):
        out[order[i]].append(slot)
    return out


def ranges(blocks: dict, weights: dict, period: int = PERIOD) -> Iterator[tuple]:
    """Ranges of at most `period` slots: (first slot of the phase, slots of the phase before the range, slots of the range, its
    sources by their place in order, their blocks before the phase, their blocks of the phase before the range).

    A phase lasts until the first of its sources has run its last block.
    """
    order, begun = sorted(blocks, key=str), 0
    done = [0] * len(order)
    while active := [i for i, s in enumerate(order) if done[i] < blocks[s]]:
        first, ran = [done[i] for i in active], [0] * len(active)
        left = [blocks[order[i]] - done[i] for i in active]
        start, before = 0, list(ran)
        for slot, i in enumerate(schedule([weights[order[i]] for i in active], ran, 0), 1):
            ends = ran[i] == left[i]
            if ends or slot - start == period:
                yield begun, start, slot - start, active, first, before
                start, before = slot, list(ran)
            if ends:
                break
        begun += slot
        for i, n in zip(active, ran):
            done[i] += n


def slots_of(spark: SparkSession, blocks: dict, weights: dict, period: int = PERIOD) -> DataFrame:
    """(mix_source, mix_block, mix_slot) of all blocks."""
    weights, order = exact(weights) if weights else {}, sorted(blocks, key=str)
    shares_of = [weights[s] for s in order]
    kept = spark.createDataFrame(list(ranges(blocks, weights, period)), "phase long, start long, slots long, sources array<int>, first array<long>, ran array<long>")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ran, runs = list(x["ran"]), []
                for slot, i in zip(range(x["slots"]), schedule([shares_of[i] for i in x["sources"]], ran, x["start"])):
                    runs.append((order[x["sources"][i]], x["first"][i] + ran[i] - 1, x["phase"] + x["start"] + slot))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*runs), (pa.string(), pa.int64(), pa.int64()))], ["mix_source", "mix_block", "mix_slot"])

    return kept.mapInArrow(lay, "mix_source string, mix_block long, mix_slot long")


def mixed(docs: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """All rows and columns of docs with `mix_source`, `mix_block` (of its source), `mix_slot` and `mix_position`.

    weights: target weight by source, positive; by default the square root of the source's rows.  A null source is a source
    of its own, under the name of the empty string, as is a source without a weight under its own name with the smallest weight
    given.  Within a source, rows are ordered by a hash of the id, so repeated rows have places next to each other.  Sorting by `mix_position` gives the mix; nothing is dropped or repeated.  Columns of docs with
    the names of the new ones are replaced.  `period` slots are made at once by a task; the order does not depend on it.
    """
    spark: SparkSession = docs.sparkSession
    salts = SALTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.drop("mix_source", "mix_block", "mix_slot", "mix_position").withColumn("mix_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(7), doc_id)).withColumn("_salt", F.pmod("_hash", F.lit(salts)).cast("int"))
    # Ranks within a source without one task for it: counts of each (source, salt), then ranks within each.
    counts = hashed.groupBy("mix_source", "_salt").agg(F.count("*").alias("n"))
    totals = {r.mix_source: r.n for r in counts.groupBy("mix_source").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    given = {("" if s is None else s): w for s, w in (weights or {s: n**0.5 for s, n in totals.items()}).items()}
    given = {s: given.get(s, min(given.values())) for s in totals}
    laid = slots_of(spark, {s: -(-n // block) for s, n in totals.items()}, given, period)
    before = Window.partitionBy("mix_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # The slots of each (source, salt), a row for so many blocks: the documents are not dealt anew for them.
    of_block = lambda rank: F.floor(rank / block).cast("long")
    wanted = offsets.select("mix_source", "_salt", "_before", F.explode(F.sequence(of_block(F.col("_before")), of_block(F.col("_before") + F.col("n") - 1))).alias("mix_block"))
    met = wanted.join(laid, ["mix_source", "mix_block"]).groupBy("mix_source", "_salt", "_before", F.floor(F.col("mix_block") / SLOTS_PER_ROW).alias("_row"))
    steps = met.agg(F.min("mix_block").alias("_first"), F.sort_array(F.collect_list("mix_slot")).alias("_slots")).drop("_row")
    steps = steps.withColumn("_after", F.col("_first") + F.size("_slots")).withColumnsRenamed({"mix_source": "_source", "_salt": "_of"})
    within = Window.partitionBy("mix_source", "_salt").orderBy("_hash", doc_id)
    ranked = hashed.withColumn("_rank", F.row_number().over(within) - 1)
    at = of_block(F.col("_rank") + F.col("_before"))
    placed = ranked.join(steps, (F.col("mix_source") == F.col("_source")) & (F.col("_salt") == F.col("_of")) & (at >= F.col("_first")) & (at < F.col("_after")))
    placed = placed.withColumn("mix_block", at).withColumn("mix_slot", F.element_at("_slots", (F.col("mix_block") - F.col("_first") + 1).cast("int")))
    out = placed.withColumn("mix_position", F.col("mix_slot") * block + (F.col("_rank") + F.col("_before")) % block)
    return out.select(*[c for c in rows.columns], "mix_block", "mix_slot", "mix_position")
