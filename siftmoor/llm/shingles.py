"""N-gram Jaccard join with a forest of count-vector R-trees.

A document is the set of its distinct shingles; equal sets are one node.  Two nodes link when the Jaccard similarity of their
sets reaches 4/5 (`NEAR` parts of `OF`).  Steps, each a Spark job:

1. Sets are counted, and a fixed table of counters says roughly how frequent shingles are.
2. Nodes that link share a shingle among the rarest fifth of each (prefix filter) and have similar sizes.  The nodes of each such
   shingle, parted at gaps of size, are a block of the forest.  Shingles meet as packed arrays; a key that one node alone has is
   gone after this step.
3. In each block the node of smallest hash is compared with the others, then, where components differ, a node drawn by a hash of
   node and block: most blocks of copies are one component then.
4. Blocks that hold several components still become R-trees: shingles are hashed into groups, the counts of each group
   are a node's coordinates, leaves are tiles of nodes of similar size.  Two nodes share at most the sum of the smaller of
   their coordinates, two leaves at most that of their upper corners; pairs of leaves, then of nodes, below the need are cut.
5. Surviving pairs are verified on the whole sets; linked nodes give connected components.

Nothing is capped: every pair that shares a rare shingle is in one component already, cut by a bound, or verified.  Shingles
and nodes are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from siftmoor.llm import words as w
from siftmoor.llm.common import buckets_for, components, stage, text_size
from siftmoor.llm.substrings import _sequences

LENGTH = 5
NEAR, OF = 4, 5
LEAST_GROUPS = 32
LEAF = 256
COUNTER_BITS, PIECES, SALTS = 20, 256, 64
FILTER_BITS = 1 << 23
BUCKET_BYTES = 12 << 20


class Sets:
    """Distinct shingles of each text of a piece, sorted within the text; `sizes` and `nodes` per text (node 0: empty)."""

    def __init__(self, column: pa.Array):
        words = w.text_words(column, w.spaces(), True)
        hashes, text, counts = words.hashes(), words.texts(), words.counts
        whole = max(0, len(hashes) - LENGTH + 1)
        at = np.flatnonzero(text[:whole] == text[LENGTH - 1 :]) if whole else np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < LENGTH))
        values = np.concatenate([w.runs(hashes, LENGTH)[at], _sequences(hashes, words.first[short], counts[short])])
        owner = np.concatenate([text[at], short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
        edges = np.searchsorted(owner, np.arange(len(counts) + 1))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            values[low:high].sort()
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=len(counts))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.nodes = np.zeros(len(counts), np.uint64)
        full = self.sizes > 0
        if full.any():
            sums = np.add.reduceat(w.mixed(self.values ^ np.uint64(0x5851F42D4C957F2D)), self.first[:-1][full])
            self.nodes[full] = np.maximum(w.mixed(sums + self.sizes[full].astype(np.uint64)), np.uint64(1))

    def points(self) -> list[np.ndarray]:
        """Shingles of each text by group, the coordinates of its node: the next power of two to the size, so that counts stay small."""
        return [np.bincount((self.values[a:b] & np.uint64(groups_for(b - a) - 1)).astype(np.int64), minlength=groups_for(b - a)).astype(np.uint16)
                for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist())]


def groups_for(size: int) -> int:
    """The number of groups of a set."""
    return max(LEAST_GROUPS, 1 << (max(1, size) - 1).bit_length())


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups: shingles of groups that agree in the low bits of their number go together."""
    return point.astype(np.int32).reshape(-1, groups).sum(axis=0)


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """No two sets with these coordinates share more shingles."""
    if len(a) == len(b):
        return int(np.minimum(a, b).sum(dtype=np.int64))
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


def packed(arrays: list[np.ndarray]) -> list[bytes]:
    """Arrays for a shuffle, all first bytes of their numbers before all second ones: small counts take a fraction of their bytes."""
    zstd = zstandard.ZstdCompressor()
    return [zstd.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) for x in arrays]


def unpacked(column, kind) -> list[np.ndarray]:
    """The arrays of `packed`, from a column or several values."""
    zstd, width = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize
    return [np.frombuffer(zstd.decompress(x.as_buffer()), np.uint8).reshape(width, -1).T.copy().view(kind).ravel() for x in column]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loads = np.zeros(1 << COUNTER_BITS, np.uint32)

    def rows(ids, sizes, nodes, points, pieces, counters):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip((ids, sizes, nodes, points, pieces, counters), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()))],
            ["id", "n", "node", "point", "piece", "loads"])

    for batch in w.slices(batches, "text"):
        sets = Sets(batch["text"])
        loads += np.bincount((sets.values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(loads)).astype(np.uint32)
        none = [None] * batch.num_rows
        yield rows(batch["id"], sets.sizes, pa.array(sets.nodes.view(np.int64), mask=sets.sizes == 0), packed(sets.points()), none, none)
    none = [None] * PIECES
    yield rows(none, none, none, none, range(PIECES), packed(np.split(loads.astype(np.int64), PIECES)))


def _total(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros((1 << COUNTER_BITS) // PIECES, np.int64)
    for part in table["loads"]:
        total += unpacked([part], np.int64)[0]
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "loads": pa.array(packed([total]), pa.binary())})


def _rarity(counted: DataFrame) -> np.ndarray:
    """The rank of each counter by its load: a fixed number of entries, however large the corpus is."""
    loads = counted.where("piece is not null").select("piece", "loads", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt"))
    rows = loads.groupBy("piece", "salt").applyInArrow(_total, "piece int, loads binary").groupBy("piece").applyInArrow(_total, "piece int, loads binary").collect()
    total = np.zeros((PIECES, (1 << COUNTER_BITS) // PIECES), np.int64)
    for row in rows:
        total[row.piece] = unpacked([pa.scalar(row.loads, pa.binary())], np.int64)[0]
    rank = np.empty(1 << COUNTER_BITS, np.uint32)
    rank[np.argsort(total.ravel(), kind="stable")] = np.arange(1 << COUNTER_BITS, dtype=np.uint32)
    return rank


def _prefix_keys(rank: np.ndarray, count: int):
    low_bits = np.uint64(64 - COUNTER_BITS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text"):
            sets = Sets(batch["text"])
            # The counter's number gives way to its rank: the same shingles under other names, rare ones first.
            named = (rank[sets.values >> low_bits].astype(np.uint64) << low_bits) | (sets.values & np.uint64((1 << (64 - COUNTER_BITS)) - 1))
            found, owners, sizes, seen = [], [], [], set()
            for i, size in enumerate(sets.sizes.tolist()):
                if size and (node := sets.nodes[i]) not in seen:
                    seen.add(node)
                    prefix = size - -(-NEAR * size // OF) + 1
                    found.append(np.partition(named[sets.first[i] : sets.first[i + 1]], prefix - 1)[:prefix])
                    owners.append(np.full(prefix, node, np.uint64))
                    sizes.append(np.full(prefix, size, np.uint32))
            if not found:
                continue
            found, owners, sizes = np.concatenate(found), np.concatenate(owners), np.concatenate(sizes)
            order, upto = w.by_bucket(w.mixed(found) % np.uint64(count), count)
            buckets = np.flatnonzero(np.diff(upto))
            found, owners, sizes = found[order], owners[order], sizes[order]
            cut = lambda x: pa.array([x[upto[b] : upto[b + 1]].tobytes() for b in buckets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), cut(found), cut(owners), cut(sizes)], ["bucket", "keys", "nodes", "sizes"])

    return keys


def _blocks(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of a block's first node with the others (block null), and members of blocks of three nodes or more.

    The nodes of a key, by size, part into blocks wherever a size is too large to be near the one before.
    """
    keys, nodes, sizes = w.joined(table["keys"], np.uint64), w.joined(table["nodes"], np.uint64), w.joined(table["sizes"], np.uint32).astype(np.int64)
    order = np.argsort(keys)
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    shared = np.zeros(len(keys), bool)
    shared[1:] = keys[1:] == keys[:-1]
    shared[:-1] |= shared[1:]
    keys, nodes, sizes = keys[shared], nodes[shared], sizes[shared]
    order = np.lexsort((nodes, sizes, keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    if not len(keys):
        return pa.table({c: pa.array([], pa.int64()) for c in ("block", "a", "b")})
    new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
    keys, nodes, sizes = keys[new], nodes[new], sizes[new]
    opens = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (OF * sizes[:-1] < NEAR * sizes[1:])))
    members = np.diff(np.append(opens, len(keys)))
    block = np.repeat(np.arange(len(opens)), members)
    order = np.lexsort((nodes, block))
    nodes, sizes = nodes[order], sizes[order]
    first, names = np.repeat(nodes[opens], members), np.repeat(w.mixed(np.add.reduceat(w.mixed(nodes), opens)), members)
    size = np.repeat(sizes[opens], members)
    near = (first != nodes) & (OF * np.minimum(size, sizes) >= NEAR * np.maximum(size, sizes))
    pairs = np.unique(np.stack([first, nodes], axis=1)[near], axis=0).view(np.int64)
    members = np.unique(np.stack([names, nodes], axis=1)[np.repeat(members, members) > 2], axis=0).view(np.int64)
    return pa.table({
        "block": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(members[:, 0])]),
        "a": np.concatenate([pairs[:, 0], members[:, 1]]), "b": np.concatenate([pairs[:, 1], members[:, 1]])})


def _whole_sets(bits: np.ndarray):
    """The sets of the texts whose id may be wanted."""

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text"):
            at = batch["bit"].to_numpy()
            wanted = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if not len(wanted):
                continue
            batch = batch.take(pa.array(wanted))
            sets = Sets(batch["text"])
            yield pa.RecordBatch.from_arrays([pa.array(sets.nodes.view(np.int64)), batch["id"], w.binary(np.split(sets.values, sets.first[1:-1]))], ["node", "id", "shingles"])

    return whole_sets


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose coordinates allow them to be near."""
    for batch in batches:
        sizes = (batch["n_a"].to_numpy() + batch["n_b"].to_numpy()).tolist()
        good = []
        for i, size in enumerate(sizes):
            a, b = unpacked([batch["point_a"][i], batch["point_b"][i]], np.uint16)
            good.append(most_shared(a, b) * (NEAR + OF) >= NEAR * size)
        good = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch[c].filter(good) for c in "ab"], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are near enough."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch[c][i].as_buffer(), np.uint64) for c in ("shingles_a", "shingles_b"))
            both = np.concatenate([a, b])
            both.sort()
            good[i] = (both[1:] == both[:-1]).sum() * (NEAR + OF) >= NEAR * len(both)
        yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(good)) for c in "ab"], ["a", "b"])


def _sides(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b) with columns of both nodes."""
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]), s)
    return pairs


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that link.  Sets are made again for the nodes concerned only; a bitmap of fixed size keeps other texts out."""
    wanted = nodes.select("node", "id").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    parts = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts:  # part 0 holds bit 0 alone, the others count bits from 1
        low = max(0, row.part - 1) * 4096
        bits[low : low + 4096] |= np.frombuffer(row.bits, np.uint8)
    place = F.when(bit == 0, F.lit(0)).otherwise((F.bitmap_bucket_number(bit) - 1) * 32768 + F.bitmap_bit_position(bit))
    sets = rows.select("id", "text", place.alias("bit")).mapInArrow(_whole_sets(bits), "node long, id long, shingles binary")
    sets = stage(sets.join(wanted, ["node", "id"], "left_semi"), "shingles")
    return stage(_sides(pairs, sets, ["shingles"]).mapInArrow(_linked, "a long, b long"), "near")


def _leaf(key: tuple, table: pa.Table) -> pa.Table:
    """A leaf: nodes of one block and band with the coordinates they all have, and the upper corner of its box."""
    table = table.sort_by([("component", "ascending"), ("node", "ascending")])
    groups = min(map(groups_for, table["n"].to_pylist()))
    points = np.array([folded(x, groups) for x in unpacked(table["point"], np.uint16)], np.int32)
    arrays = {c: table[c].to_numpy() for c in ("node", "component", "n")}
    arrays = dict(zip(("corner", "points", "nodes", "components", "ns"), packed([points.max(axis=0), points, *arrays.values()])))
    row = {"block": key[0].as_py(), "band": key[1].as_py(), "leaf": key[2].as_py(), "least": min(table["n"].to_pylist()), **arrays}
    return pa.Table.from_pylist([row], schema=pa.schema([(c, k) for c, k in zip(row, [pa.int64(), pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5)]))


_LEAF = "block long, band int, leaf int, least long, corner binary, points binary, nodes binary, components binary, ns binary"


def _near_points(buckets: int):
    """Pairs of nodes of two leaves, in different components, that the coordinates allow to be near.

    The same pair comes from every block that its nodes share, so a task leaves out repetitions and packs pairs by bucket.
    """

    def emit(found: list) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        order, upto = w.by_bucket(w.mixed(w.mixed(pairs[:, 0].view(np.uint64)) ^ pairs[:, 1].view(np.uint64)) % np.uint64(buckets), buckets)
        pairs, full = pairs[order], np.flatnonzero(np.diff(upto))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), w.binary([pairs[upto[i] : upto[i + 1]] for i in full])], ["bucket", "pairs"])

    def near_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                pairs = _leaf_pairs(lambda name, kind: unpacked([batch[name][row]], kind)[0], batch["least"][row].as_py() + batch["least_2"][row].as_py())
                found, held = [*found, *pairs], held + sum(map(len, pairs))
                if held > 1 << 20:
                    yield emit(found)
                    found, held = [], 0
        if held:
            yield emit(found)

    return near_points


def _leaf_pairs(get, least: int) -> list[np.ndarray]:
    if most_shared(get("corner", np.int32), get("corner_2", np.int32)) * (NEAR + OF) < NEAR * least:
        return []
    (nodes, comps, sizes, points), (nodes_2, comps_2, sizes_2, points_2) = (
        (get(f"nodes{s}", np.int64), get(f"components{s}", np.int64), get(f"ns{s}", np.int64), get(f"points{s}", np.int32)) for s in ("", "_2"))
    groups = min(len(points) // len(nodes), len(points_2) // len(nodes_2))
    points, points_2 = (x.reshape(count, -1, groups).sum(axis=1) for x, count in ((points, len(nodes)), (points_2, len(nodes_2))))
    out = []
    for i in range(len(nodes)):
        maybe = np.flatnonzero((comps_2 != comps[i]) & (OF * np.minimum(sizes_2, sizes[i]) >= NEAR * np.maximum(sizes_2, sizes[i])))
        other = nodes_2[maybe[np.minimum(points[i], points_2[maybe]).sum(axis=1) * (NEAR + OF) >= NEAR * (sizes[i] + sizes_2[maybe])]]
        if len(other):
            out.append(np.stack([np.minimum(nodes[i], other), np.maximum(nodes[i], other)], axis=1))
    return out


def _distinct_pairs(key: tuple, table: pa.Table) -> pa.Table:
    pairs = np.unique(w.joined(table["pairs"], np.int64).reshape(-1, 2), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _mixed_blocks(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of blocks that hold several components, with their component."""
    labelled = members.join(found, "node", "left").select("block", "node", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("block")
    return labelled.join(several, "block")


def _second_stars(mixed: DataFrame) -> DataFrame:
    """Each member of a block with a member drawn by a hash of node and block, if their components differ."""
    drawn = mixed.groupBy("block").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", "block")).alias("drawn"))
    pairs = mixed.join(drawn, "block").where("component <> drawn.component")
    return pairs.select(F.least("node", "drawn.node").alias("a"), F.greatest("node", "drawn.node").alias("b")).distinct()


def _tree_pairs(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate pairs between components that share a block, by a join of R-tree leaves."""
    band = F.floor(F.log("n") / F.log(F.lit(OF / NEAR))).cast("int")
    placed = mixed.join(nodes.select("node", "n", "point"), "node").withColumn("band", band)
    tiles = placed.groupBy("block", "band").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("leaves"))
    leaves = placed.join(tiles, ["block", "band"]).withColumn("leaf", F.pmod(F.xxhash64("node"), F.col("leaves")).cast("int")).groupBy("block", "band", "leaf").applyInArrow(_leaf, _LEAF)
    leaves = stage(leaves, "leaves")
    other = leaves.select("block", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("band_2"), F.col("leaf").alias("leaf_2"),
                          *[F.col(c).alias(f"{c}_2") for c in ("least", "corner", "points", "nodes", "components", "ns")])
    buckets = 4 * int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = leaves.join(other, ["block", "band"]).where("band < band_2 or leaf <= leaf_2").mapInArrow(_near_points(buckets), "bucket int, pairs binary")
    return packed.groupBy("bucket").applyInArrow(_distinct_pairs, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs; component_id is the smallest id that links reach.

    Words are runs of other than spaces and 0x09-0x0D, with A-Z lower-cased.  Texts with fewer than LENGTH words have their
    whole sequence as the one shingle.  Null texts and texts without words have none and link with nothing.  Rows with a null
    id are kept apart: their component is null.  Repeated rows give a row each.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = stage(rows.mapInArrow(_count, "id long, n long, node long, point binary, piece int, loads binary"), "sets")
    seen = counted.where("piece is null").select("id", "n", "node", "point")
    nodes = stage(seen.where("id is not null and node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("point").alias("point")), "nodes")
    known = rows.where("id is not null")
    count = buckets_for(6 * text_size(docs, text_col) // 10, BUCKET_BYTES)
    keys = known.mapInArrow(_prefix_keys(_rarity(counted), count), "bucket int, keys binary, nodes binary, sizes binary")
    met = stage(keys.groupBy("bucket").applyInArrow(_blocks, "block long, a long, b long"), "blocks")
    stars = met.where("block is null").select("a", "b").distinct()
    members = met.where("block is not null").select("block", F.col("a").alias("node")).distinct()
    possible = lambda pairs: stage(_sides(_sides(pairs, nodes, ["n"]).where(f"{OF} * least(n_a, n_b) >= {NEAR} * greatest(n_a, n_b)"), nodes, ["point"]).mapInArrow(_possible, "a long, b long"), "pairs")
    links = _verified(possible(stars), nodes, known)
    found = components(links)
    for candidates in (lambda mixed: possible(_second_stars(mixed)), lambda mixed: stage(_tree_pairs(mixed, nodes), "pairs")):
        mixed = stage(_mixed_blocks(members, found), "mixed")
        if (pairs := candidates(mixed)).head(1):
            links = links.union(_verified(pairs, nodes, known))
            found = components(links)
    labelled = seen.join(found, "node", "left").select("id", "n", F.coalesce("component", "node").alias("c"))
    least = labelled.where("c is not null").groupBy("c").agg(F.min("id").alias("least"))
    return labelled.join(least, "c", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
